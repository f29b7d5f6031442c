"""Queries over small tables made for them, against their SQL."""

import duckdb
import pytest

from millrace.registry import ORACLE_SQL, QUERIES, load
from tests.test_oracles import normal

load()


@pytest.fixture
def same(spark, tmp_path):
    def check(name, **tables):
        c = duckdb.connect()
        c.execute("SET TimeZone = 'UTC'")
        for t, df in tables.items():
            df.write.parquet(str(tmp_path / f"{t}.parquet"))
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        got, want = QUERIES[name](spark, str(tmp_path)), c.execute(ORACLE_SQL[name])
        names, rows = [x[0] for x in want.description], want.fetchall()
        assert sorted(got.columns) == sorted(names)
        assert normal(got.columns, got.collect()) == normal(names, rows)
        return rows

    return check


def test_feedback_routes_with_equal_digits_of_two_kinds(spark, same):
    import hashlib

    seen, pair = {}, None
    for user in range(200_000):
        for kind in ("error", "view"):
            digits = hashlib.sha1(f"{kind}:{user}".encode()).hexdigest()[:8]
            other = seen.setdefault(digits, (kind, user))
            pair = pair or (other[0] != kind and [other, (kind, user)])
    rows = [*pair, *pair, ("view", 1), ("signup", 1), ("click", None), ("view", None)]
    assert len(same("feedback_routes", events=spark.createDataFrame(rows, "event_type string, user_id long"))) == 6


def test_page_heads_of_odd_pages(spark, same):
    pages = [
        "<h1>a&amp b</h1><li>x<b>y</b></li><li></li>", "<h2><b>in</b></h2><h3>next</h3>", "<h1> </h1><h2>second</h2>", "<H3 class='x'> two\n words\t</H3><LI>1<li>2", "<h1>&amp;lt; &quot;q&quot; &#39;s&#39; &nbsp;</h1>",
        "no head<li>", "", None, "<h1>\n</h1>", "<!-- <h1>hidden</h1> --><h2>shown</h2><link rel='x'>", "<h1>open", "<h1\nid='y'>x\u00a0y\u2003z</h1>", "<h7>no</h7><h6>six</h6>", "<h1>a\x0bb</h1>", "<h1>&&&</h1><ul></ul>",
    ]
    rows = [(i, p) for i, p in enumerate(pages)] + [(None, "<h1>none</h1>"), (77, "<h1>a</h1>"), (77, "<h1>b</h1><li>")]
    assert len(same("page_heads", pages=spark.createDataFrame(rows, "page_id long, html string"))) > 8
