"""Toxicity by a convolutional text classifier trained in numpy.

A word is the sum of hashed embeddings (of the word, its first four and its first six bytes). Filters of widths 1 to 3
slide over the words, each keeps its largest response in the document (max pooling), and a logistic layer scores
them. Because an embedding followed by a filter is one linear map, scoring looks up each word's responses in a table.

Every labelled row that may be learnt from is used: four fifths in the fit, the rest to calibrate scores and a threshold
for each language. The rows of the fit are dealt by hash over shards of bounded size. In each round every shard goes on
from the same model over its own rows, and the shards' steps are averaged by Spark, those of an embedding over the shards
that moved it; sums are of whole numbers, so the model does not depend on the order of shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from millrace.llm import textbuf as tb
from millrace.llm.scratch import BATCH_BYTES, Scratch, unused
from millrace.llm.workers import give_back, gives_back

WIDTHS = (1, 2, 3)
#: Rows and bytes of text of a shard of the fit, about; their number grows with the labelled rows, and none is left out.
SHARD_ROWS, SHARD_BYTES = 2500, 8 << 20
#: Most bits of the filter that keeps unlabelled texts out of the join with labels (8 MB).
FILTER_BITS = 1 << 26
#: Steps of shards are summed as whole numbers of 1 / UNIT.
UNIT = 1 << 24
#: Words whose responses are held at once.
BLOCK_WORDS = 1 << 15
THRESHOLD = 0.3
#: Thresholds that are tried.
GRID = np.arange(1, 100) / 100
#: Rows that labels may be learnt from.
LEARNT = "crc32(cast(cast(doc_id AS string) AS binary)) % 4 != 2"


@dataclass(frozen=True)
class Config:
    bits: int = 13
    dim: int = 8
    filters: int = 12
    epochs: int = 12  # over one shard
    rounds: int = 4  # over several shards, each of so many epochs:
    local_epochs: int = 2
    batch: int = 32
    least_steps: int = 64  # of an epoch over one of several shards, by smaller batches where it has few (long) rows
    rate: float = 0.01
    decay: float = 1e-5
    seed: int = 7
    spread: float = 0.02


@dataclass
class Model:
    config: Config
    embed: np.ndarray  # buckets of three kinds x dim
    conv: list[np.ndarray]  # for each width: width x dim x filters
    bias: np.ndarray  # of all filters
    out: np.ndarray
    out_bias: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def tables(self) -> list[np.ndarray]:
        """For each width and place in the filter: the responses of each bucket."""
        return [np.ascontiguousarray((self.embed @ w[j]).astype(np.float32)) for w in self.conv for j in range(len(w))]


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(words x 3 bucket numbers, first word of each row)."""
    low = tb.LOWER[data]
    starts, ends, first = tb.words(low, offsets, tb.ALNUM)
    kinds = []
    for kind, end in enumerate((ends, np.minimum(ends, starts + 4), np.minimum(ends, starts + 6))):
        kinds.append((tb.span_hashes(low, starts, end) >> np.uint64(64 - bits)).astype(np.int32) + (kind << bits))
    return np.stack(kinds, 1) if len(starts) else np.zeros((0, 3), np.int32), first


def logits(model: Model, tables: list[np.ndarray], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Raw scores of each row of a chunk."""
    ids, first = features(data, offsets, model.config.bits)
    n, rows = len(ids), len(offsets) - 1
    hidden = np.zeros((rows, len(model.bias)), np.float32)
    hidden -= 1e9
    at, f = 0, model.config.filters
    for k, width in enumerate(WIDTHS):
        ok = tb.inside_rows(n, first, width)
        for s in range(0, n, BLOCK_WORDS):
            e = min(n, s + BLOCK_WORDS)
            total = np.zeros((e - s, f), np.float32)
            for j in range(width):
                part = ids[s + j : e + j]
                for kind in range(3):
                    total[: len(part)] += tables[at + j][part[:, kind]]
            total[~ok[s:e]] = -1e9
            lo, hi = np.searchsorted(first, s, "right") - 1, np.searchsorted(first, e, "left")
            here = np.arange(lo, hi)[np.minimum(first[lo + 1 : hi + 1], e) > np.maximum(first[lo:hi], s)]
            own = hidden[here, k * f : (k + 1) * f]
            hidden[here, k * f : (k + 1) * f] = np.maximum(own, np.maximum.reduceat(total, np.maximum(first[here], s) - s, axis=0))
        at += width
    hidden += model.bias
    np.maximum(hidden, 0, out=hidden)
    return hidden @ model.out + model.out_bias


def initial(config: Config, rng: np.random.Generator) -> Model:
    f = config.filters
    return Model(config, rng.normal(0, config.spread, (3 << config.bits, config.dim)), [rng.normal(0, 0.3, (w, config.dim, f)) for w in WIDTHS], np.zeros(f * len(WIDTHS)), rng.normal(0, 0.3, f * len(WIDTHS)), np.zeros(1))


def class_weights(labels: np.ndarray, bad: int, good: int) -> np.ndarray:
    """Weights of rows by which both classes count alike, where there are so many rows of each in all."""
    return np.where(labels == 1, 0.5 / max(1, bad), 0.5 / max(1, good)) * (bad + good)


def fit(texts: list[str], labels: np.ndarray, config: Config = Config()) -> Model:
    """A model from texts at hand, as one shard."""
    rng = np.random.default_rng(config.seed)
    model = initial(config, rng)
    docs = []
    for text in texts:
        data = np.frombuffer((text or "").encode(), np.uint8)
        docs.append(features(data, np.array([0, len(data)]), config.bits)[0])
    improve(model, docs, labels, class_weights(labels, (labels == 1).sum(), (labels == 0).sum()), config.epochs, config.batch, rng)
    return model


def improve(model: Model, docs: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, epochs: int, batch: int, rng: np.random.Generator) -> np.ndarray:
    """Adam on the weighted logistic loss, in place; a fixed seed makes it repeatable. Returns how often each embedding was
    pushed."""
    config, pushes = model.config, np.zeros(len(model.embed), np.int64)
    dense = _dense(model)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in dense.items()}
    embed_m, embed_v = np.zeros_like(model.embed), np.zeros_like(model.embed)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for b in range(0, len(order), batch):
            part = order[b : b + batch]
            step += 1
            grads, at, pushed = _gradients(model, [docs[i] for i in part], labels[part], weight[part] / len(part))
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, v in dense.items():
                m, s = moments[k]
                m += 0.1 * (grads[k] - m)
                s += 0.001 * (grads[k] ** 2 - s)
                v -= config.rate * fix * m / (np.sqrt(s) + 1e-8) + config.rate * config.decay * v
            if len(at):
                rows, inverse, times = np.unique(at, return_inverse=True, return_counts=True)
                total = np.stack([np.bincount(inverse, pushed[:, c], len(rows)) for c in range(config.dim)], 1)
                embed_m[rows] += 0.1 * (total - embed_m[rows])
                embed_v[rows] += 0.001 * (total**2 - embed_v[rows])
                model.embed[rows] -= config.rate * fix * embed_m[rows] / (np.sqrt(embed_v[rows]) + 1e-8)
                pushes[rows] += times
    return pushes


def _dense(model: Model) -> dict[str, np.ndarray]:
    return {"out": model.out, "out_bias": model.out_bias, "bias": model.bias, **{f"conv{k}": w for k, w in enumerate(model.conv)}}


def _gradients(model: Model, docs: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
    """Gradients of the weighted loss of some documents: of the dense parts by name, and of the embeddings as rows (bucket,
    push). Documents stand end to end, each followed by blank words, so that no filter sees two of them; the words of
    BLOCK_WORDS places are embedded at once, so a long text takes little more than its bucket numbers."""
    f, gap = model.config.filters, max(WIDTHS)
    size = np.array([len(d) for d in docs])
    first = np.concatenate([[0], np.cumsum(size + gap)])
    ids = np.zeros((first[-1], 3), np.int32)
    for d, s in zip(docs, first, strict=False):
        ids[s : s + len(d)] = d
    hidden, where = np.full((len(docs), f * len(WIDTHS)), -1e9), np.zeros((len(docs), f * len(WIDTHS)), np.int64)
    for start in range(0, int(first[-1]), BLOCK_WORDS):
        end = min(int(first[-1]), start + BLOCK_WORDS)
        words = model.embed[ids[start : end + gap - 1]].sum(1)
        here = range(int(np.searchsorted(first, start, "right")) - 1, int(np.searchsorted(first[:-1], end, "left")))
        for k, width in enumerate(WIDTHS):
            n, cols = len(words) - width + 1, slice(k * f, (k + 1) * f)
            total = sum(words[j : n + j] @ model.conv[k][j] for j in range(width))
            for d in here:
                a, b = max(int(first[d]), start), min(int(first[d] + size[d]) - width + 1, end)
                if a < b:
                    own = total[a - start : b - start]
                    best = own.argmax(0)
                    top = own[best, np.arange(f)]
                    more = top > hidden[d, cols]
                    hidden[d, cols] = np.where(more, top, hidden[d, cols])
                    where[d, cols] = np.where(more, best + a, where[d, cols])
    hidden = np.maximum(hidden + model.bias, 0)
    z = hidden @ model.out + model.out_bias[0]
    delta = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * weight
    back = delta[:, None] * model.out * (hidden > 0)
    grads = {"out_bias": np.array([delta.sum()]), "out": delta @ hidden, "bias": back.sum(0)}
    touched, pushed = [], []
    for k, width in enumerate(WIDTHS):
        g, p = back[:, k * f : (k + 1) * f], where[:, k * f : (k + 1) * f]
        d, c = np.nonzero(g)
        grads[f"conv{k}"] = np.zeros_like(model.conv[k])
        for j in range(width):
            grads[f"conv{k}"][j] = np.einsum("df,dfe->ef", g, model.embed[ids[p + j]].sum(2))
            touched.append(ids[p[d, c] + j].ravel())
            pushed.append(np.repeat(g[d, c][:, None] * model.conv[k][j].T[c], 3, axis=0))
    return grads, np.concatenate(touched), np.concatenate(pushed)


def calibrate(model: Model, scored: DataFrame | None, share: float) -> None:
    """Sets scale and shift (logistic regression of toxic on the raw score z, lightly shrunk) so that scores are
    probabilities where the given share of texts has label 1. Without both classes every score is near it. Each step of
    Newton's method is one sum over all rows."""
    a, share = 0.0, np.clip(share, 1e-3, 1 - 1e-3)
    b = np.log(share / (1 - share))
    n, bad, spread = scored.agg(F.count("z"), F.sum("toxic"), F.stddev_pop("z")).head() if scored is not None else (0, 0, 0.0)
    if n and 0 < bad < n:
        a, b = 1 / max(1.0, spread), 0.0
        z, t = F.col("z"), F.when(F.col("toxic") == 1, (bad + 1) / (bad + 2)).otherwise(1 / (n - bad + 2))
        for _ in range(200):
            p = 1 / (1 + F.exp(-F.least(F.greatest(F.lit(a) * z + F.lit(b), F.lit(-30.0)), F.lit(30.0))))
            w = F.greatest(p * (1 - p), F.lit(1e-6))
            ga, gb, haa, hab, hbb = scored.agg(*(F.avg(x) for x in ((p - t) * z, p - t, w * z * z, w * z, w))).head()
            da, db = np.linalg.solve(np.array([[haa + 1e-3, hab], [hab, hbb + 1e-6]]), np.array([ga + 1e-3 * a, gb]))
            a, b = float(a - np.clip(da, -0.5, 0.5)), float(b - np.clip(db, -0.5, 0.5))
            if max(abs(da), abs(db)) < 1e-9:
                break
        b += np.log(share / (1 - share)) - np.log(bad / (n - bad))
    model.scale, model.shift = round(max(float(a), 1e-3), 7), round(float(b), 7)  # averages vary in their last places


def raw_scores(model: Model, texts: list[str]) -> np.ndarray:
    tables, column = model.tables(), pa.array([t or "" for t in texts], pa.string())
    return np.concatenate([logits(model, tables, data, offsets) for _, _, data, offsets in tb.chunks(column)] or [np.zeros(0)])


def best_threshold(p: np.ndarray, labels: np.ndarray, share: float, default: float = THRESHOLD, times: np.ndarray | None = None) -> float:
    """The threshold, on GRID, of the best F1 where the given share of texts has label 1, and of several the one nearest to
    ``default``; ``default`` itself where one of the classes is missing. times: how often each text counts (else once)."""
    if not 0 < labels.sum() < len(labels):
        return default
    n = np.ones(len(labels)) if times is None else times
    w = n * np.where(labels == 1, share / n[labels == 1].sum(), (1 - share) / n[labels == 0].sum())
    f1 = [2 * (w * labels)[p >= t].sum() / (share + w[p >= t].sum()) for t in GRID]
    near = np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)
    return float(GRID[near[np.argmin(np.abs(GRID[near] - default))]])


def language_thresholds(model: Model, scored: DataFrame, share: float) -> dict[str, float]:
    """The best threshold of each language that has both classes among all scored rows, from their numbers by step of GRID."""

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _probability(model, batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.searchsorted(GRID, p, "right"), pa.int32())], ["toxic", "lang", "step"])

    counts = scored.select("z", "toxic", F.coalesce("lang", F.lit("")).alias("lang")).mapInArrow(steps, "toxic int, lang string, step int").groupBy("lang", "toxic", "step").count()
    both = counts.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("toxic", "step", "count"))).alias("found"), F.min("toxic").alias("a"), F.max("toxic").alias("b")).where("a < b")
    out = {}
    for r in both.orderBy("lang").collect():
        y, step, n = np.array(r.found, np.int64).T
        out[r.lang] = best_threshold((step + 0.5) / (len(GRID) + 1), y, min(max(share, 1e-3), 1 - 1e-3), times=n)
    return out


def _labelled(docs: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """doc_id, text, lang and toxic of every row of docs with a text and one of the n known labels. So that not all texts
    are shuffled, a filter of hashed bits (of a size that is bounded) first leaves out most that have no label; the join
    itself is exact, and by hash so that texts are not sorted."""
    bits = min(FILTER_BITS, 1 << max(15, (16 * n).bit_length()))
    at = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(bits)) + 1
    marks = known.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("marks"))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").where(LEARNT).select("doc_id", "text", lang.alias("lang"), F.bitmap_bucket_number(at).alias("part"), F.bitmap_bit_position(at).alias("place"))
    byte = F.conv(F.hex(F.substring(F.col("marks"), (F.col("place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.floor(byte / F.pow(F.lit(2), F.col("place") % 8)) % 2 == 1
    return texts.join(F.broadcast(marks), "part").where(marked).select("doc_id", "text", "lang").join(known.hint("shuffle_hash"), "doc_id")


def _packed(key: tuple, table: pa.Table, bits: int) -> pa.Table:
    """A shard's rows as one: bucket numbers of its words, words and label of each row."""
    give_back()  # of the shard before
    order = pa.table({"id": table["doc_id"].cast(pa.string()), "text": table["text"], "toxic": table["toxic"]})
    table = table.take(pc.sort_indices(order, [(c, "ascending") for c in order.column_names]))
    ids, sizes = [], []
    for part in table["text"].chunks:
        for _, _, data, offsets in tb.chunks(part):
            found, first = features(data, offsets, bits)
            found -= np.arange(3, dtype=np.int32) << bits
            ids.append(found.astype(_small(bits)).tobytes())
            sizes.append(np.diff(first).astype(np.int64).tobytes())
    labels = table["toxic"].to_numpy().astype(np.int8).tobytes()
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "ids": [b"".join(ids)], "sizes": [b"".join(sizes)], "labels": [labels]})


def _small(bits: int) -> type:
    return np.uint16 if bits <= 16 else np.uint32


@gives_back
def _steps(batches: Iterator[pa.RecordBatch], shared, count: int, turn: int, bad: int, good: int) -> Iterator[pa.RecordBatch]:
    """What each shard adds to the model, as rows (part, weight, steps of dim numbers times weight), in units. Parts are the
    embeddings by bucket, then the dense numbers, dim at a time; an embedding that a shard did not push is not there."""
    for rows in batches:
        for shard, ids, sizes, labels in zip(*rows.columns, strict=True):
            old, model = shared.value, _copy(shared.value)
            epochs = model.config.epochs if count == 1 else model.config.local_epochs
            bits, dim = model.config.bits, model.config.dim
            words = np.frombuffer(ids.as_buffer(), _small(bits)).reshape(-1, 3).astype(np.int32)
            words += np.arange(3, dtype=np.int32) << bits
            docs = np.split(words, np.cumsum(np.frombuffer(sizes.as_buffer(), np.int64))[:-1])
            y = np.frombuffer(labels.as_buffer(), np.int8).astype(np.int64)
            batch = model.config.batch if count == 1 else min(model.config.batch, max(4, len(y) // model.config.least_steps))
            pushes = improve(model, docs, y, class_weights(y, bad, good), epochs, batch, np.random.default_rng([model.config.seed, turn, shard.as_py()]))
            moved = np.flatnonzero(pushes)
            rest = _flat(model) - _flat(old)
            part = np.concatenate([moved, len(pushes) + np.arange(len(rest))])
            weight = np.concatenate([pushes[moved], np.full(len(rest), len(y))])
            step = np.concatenate([(model.embed - old.embed)[moved], rest])
            units = np.rint(step * weight[:, None] * UNIT).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(weight), *(pa.array(units[:, c]) for c in range(dim))], ["part", "weight", *(f"s{c}" for c in range(dim))])


def _copy(model: Model) -> Model:
    return Model(model.config, model.embed.copy(), [w.copy() for w in model.conv], model.bias.copy(), model.out.copy(), model.out_bias.copy())


def _flat(model: Model) -> np.ndarray:
    """The dense numbers, dim to a row."""
    found = np.concatenate([v.ravel() for v in _dense(model).values()])
    return np.pad(found, (0, -len(found) % model.config.dim)).reshape(-1, model.config.dim)


def _move(model: Model, part: np.ndarray, step: np.ndarray) -> None:
    """Adds averaged steps by part."""
    embed = part < len(model.embed)
    model.embed[part[embed]] += step[embed]
    flat = _flat(model)
    flat[part[~embed] - len(model.embed)] += step[~embed]
    flat, at = flat.ravel(), 0
    for v in _dense(model).values():
        v[...] = flat[at : at + v.size].reshape(v.shape)
        at += v.size


def train(docs: DataFrame, labels: DataFrame, config: Config = Config()) -> Model:
    """Learns from every labelled row whose crc32(doc_id as text) mod 4 is not 2 (without a label or text there is nothing to
    learn from): four fifths are fitted on, by shards, and one fifth calibrates. The driver receives the model, of a fixed
    size, and sums. docs has doc_id, text and, for thresholds by language, lang."""
    spark = docs.sparkSession
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(LEARNT).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    model = initial(config, np.random.default_rng(config.seed))
    if not counts:
        calibrate(model, None, share)
        return model
    scratch = Scratch(spark, "toxicity", BATCH_BYTES)
    apart = F.pmod(F.crc32(F.concat(F.lit("fit"), F.col("doc_id").cast("string"))), F.lit(5)) == 0
    rows = scratch.save(_labelled(docs, known, sum(counts.values())).withColumn("apart", apart), "labelled")
    fitted = rows.where("NOT apart")
    n, bad, size = fitted.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()
    count = max(1, ceil(n / SHARD_ROWS), ceil(size / SHARD_BYTES))
    shard = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(count))
    bits, dim = config.bits, config.dim
    shards = scratch.save(fitted.select("doc_id", "text", "toxic", shard.alias("shard")).groupBy("shard").applyInArrow(lambda key, t: _packed(key, t, bits), "shard long, ids binary, sizes binary, labels binary"), "shards")
    names = [f"s{c}" for c in range(dim)]
    for turn in range(0 if not n else 1 if count == 1 else config.rounds):
        shared = spark.sparkContext.broadcast(model)
        steps = shards.mapInArrow(lambda b, s=shared, t=turn: _steps(b, s, count, t, bad, n - bad), ", ".join(f"{c} long" for c in ("part", "weight", *names)))
        summed = scratch.save(steps.groupBy("part").agg(*(F.sum(c).alias(c) for c in ("weight", *names))), f"round{turn}").toArrow()
        total = np.stack([summed[c].to_numpy() for c in names], 1) / UNIT / summed["weight"].to_numpy()[:, None]
        model = _copy(model)
        _move(model, summed["part"].to_numpy(), total)
        shared.unpersist()
    shared = spark.sparkContext.broadcast(model)
    scored = scratch.save(rows.where("apart").select("toxic", "lang", "text").mapInArrow(lambda b: _raw(b, shared), "z double, toxic int, lang string"), "scored")
    calibrate(model, scored, share)
    model.thresholds = language_thresholds(model, scored, share)
    scratch.drop()
    return model


@gives_back
def _raw(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    tables = shared.value.tables()
    for batch in batches:
        z = [logits(shared.value, tables, data, offsets) for _, _, data, offsets in tb.chunks(batch.column(2), 1 << 18)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z or [np.zeros(0)]).astype(np.float64)), *batch.columns[:2]], ["z", "toxic", "lang"])


def _probability(model: Model, z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.scale * z.astype(np.float64) + model.shift, -30, 30)))


@gives_back
def _score(batches: Iterator[pa.RecordBatch], shared, text: int, kept: int) -> Iterator[pa.RecordBatch]:
    """The first kept columns and the score of the one numbered text."""
    model = shared.value
    tables = model.tables()
    for batch in batches:
        scores = [logits(model, tables, data, offsets) for _, _, data, offsets in tb.chunks(batch.column(text), 1 << 18)]
        z = np.concatenate(scores) if scores else np.zeros(0)
        yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(_probability(model, z))], [*batch.schema.names[:kept], "score"])


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The carried columns of every row and its score from 0 to 1 as ``name``, from the whole text alone. A null or empty
    text gets the score of no words; repeated rows get a row each; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = carry.index("text") if "text" in carry else len(carry)  # a text that is carried is sent once
    sent = docs.select(*carry, *([F.col("text").alias(unused(docs, "scored_text"))] if text == len(carry) else []))
    schema = StructType([*sent.schema.fields[: len(carry)], StructField(name, DoubleType())])

    def scored(batches):
        for batch in _score(batches, shared, text, len(carry)):
            yield batch.rename_columns(schema.names)

    return sent.mapInArrow(scored, schema)


def threshold_of(model: Model, lang: Column) -> Column:
    """The model's threshold for a language; THRESHOLD for one that it has not seen."""
    if not model.thresholds:
        return F.lit(THRESHOLD)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in model.thresholds.items() for x in pair)), F.coalesce(lang, F.lit(""))), F.lit(THRESHOLD))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of documents; then threshold, that of the row's language, and
    predicted_by_language, the prediction under it. A row of a null doc_id is scored and not held out (held_out false)."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels)
    scored = score(docs, model, ("doc_id", "lang")).withColumn("threshold", threshold_of(model, F.col("lang")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scored.select(
        F.col("doc_id").cast("long"),
        held.alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
        "threshold",
        F.when(F.col("score") >= F.col("threshold"), 1).otherwise(0).alias("predicted_by_language"),
    )
