"""Packing of tokenized documents into fixed windows whose content follows a source mixture."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.tables import parallelism
from terraloom.llm.text import parts
from terraloom.llm.tokens import coder, tokenizer_path
from terraloom.session import materialize, ship_package

WINDOW = 2048
#: Tokens a source saves up before it is served; its deficit, never more than this, is carried to the next window.
GRANULE = 128
#: Largest sources that always have a queue of their own, and queues that the smaller ones without a weight share by hash.
QUEUES = 512
#: What a document counts in bytes besides its text when sources are compared by size: about its end token.
END_BYTES = 4
#: Rounds times queues that are laid out at once.
BLOCK = 1 << 20
#: Weights are scaled to about this total, so that the window arithmetic stays within 64 bits for 2^36 windows.
WEIGHT_TOTAL = 1 << 26


class Schedule:
    """Deficit round-robin in closed form.

    In every round queue k is credited window * w_k / w tokens and sends as many whole granules as its credit holds; what
    is left is its deficit, carried on. After r rounds it has sent sent(r)[k] tokens in all, so the place of any token
    among all tokens follows from its place in its queue alone, whichever partition holds it.
    """

    def __init__(self, totals: np.ndarray, weights: np.ndarray, window: int, granule: int):
        self.totals, self.granule = totals.astype(np.int64), granule
        scaled = np.maximum(1, np.round(weights / weights.sum() * WEIGHT_TOTAL)).astype(np.int64) if len(weights) else weights.astype(np.int64)
        self.divisor = int(scaled.sum()) * granule
        self.whole, self.part = np.divmod(scaled * window, self.divisor) if len(weights) else (scaled, scaled)
        self.rate = scaled * window / self.divisor if len(weights) else scaled

    def granules(self, rounds: np.ndarray, k: int | slice = slice(None)) -> np.ndarray:
        return rounds * self.whole[k] + rounds * self.part[k] // self.divisor

    def sent(self, rounds: np.ndarray) -> np.ndarray:
        return np.minimum(self.totals, self.granules(rounds[:, None]) * self.granule)

    def round_of(self, granule: np.ndarray, k: int) -> np.ndarray:
        """The round in which queue k sends a granule."""
        r = np.maximum(0, ((granule + 1) / self.rate[k]).astype(np.int64) - 3)
        for _ in range(6):
            r += self.granules(r + 1, k) <= granule
        return r

    def segments(self, k: int, start: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and lengths of the runs in which tokens start..start+n of queue k are sent."""
        first, last = start // self.granule, (start + n - 1) // self.granule
        rounds = np.unique(self.round_of(np.arange(first, last + 1), k))
        step, out = max(1, BLOCK // len(self.totals)), []
        for s in range(0, len(rounds), step):
            done, then = self.sent(rounds[s:s + step]), self.sent(rounds[s:s + step] + 1)
            lo, hi = np.maximum(done[:, k], start), np.minimum(then[:, k], start + n)
            out.append((done.sum(axis=1) + (then - done)[:, :k].sum(axis=1) + lo - done[:, k], hi - lo))
        place, length = zip(*out)
        return np.concatenate(place), np.concatenate(length)


def cut(place: np.ndarray, length: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Start (counted along the runs) and place of every piece: runs joined where they touch, then cut at window ends and at `bounds`."""
    ends = place + length
    opens = np.flatnonzero(np.append(True, place[1:] != ends[:-1]))
    along = (np.cumsum(length) - length)[opens]
    place, ends = place[opens], ends[np.append(opens[1:] - 1, len(ends) - 1)]
    pieces = (ends - 1) // window - place // window + 1
    which = np.repeat(np.arange(len(place)), pieces)
    step = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = along[which] + np.maximum(place[which], (place[which] // window + step) * window) - place[which]
    at = np.union1d(at, bounds)
    which = np.searchsorted(along, at, side="right") - 1
    return at, place[which] + at - along[which]


def queued(docs: DataFrame, seed: int, weighted: list[str]) -> tuple[DataFrame, list[str]]:
    """(doc_id, queue, text, _order ...) and the columns that order documents within the queues.

    '=' and its name is the queue of a source, '' that of the null source, '#' and a number a shared one. The `weighted`
    sources and the QUEUES largest by bytes have their own, so that each of the others has less than 1 in QUEUES of all
    bytes. A shared queue takes its sources side by side: each spreads its documents, in seeded order, evenly over it.
    """
    source, text = F.col("source").cast("string"), F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), source.alias("_source"))
    rows = rows.withColumn("_order", F.xxhash64(F.lit(seed), "doc_id", "text"))
    own, order = F.coalesce(F.concat(F.lit("="), F.col("_source")), F.lit("")), ["queue", "_order", "doc_id"]
    if rows.select("_source").distinct().limit(QUEUES + 1).count() <= QUEUES:
        return rows.withColumn("queue", own).drop("_source"), order
    rows = rows.withColumn("_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + END_BYTES)
    largest = rows.where("_source IS NOT NULL").groupBy("_source").agg(F.sum("_bytes").alias("n")).orderBy(F.desc("n"), "_source").limit(QUEUES).collect()
    alone = F.col("_source").isNull() | F.col("_source").isin(sorted({r[0] for r in largest} | set(weighted)))
    small = rows.where(~alone).withColumn("queue", F.concat(F.lit("#"), F.pmod(F.xxhash64("_source"), F.lit(QUEUES)).cast("string")))
    every = Window.partitionBy("_source")  # less than 1 in QUEUES of all bytes
    earlier = F.sum("_bytes").over(every.orderBy("_order", "doc_id", "text").rowsBetween(Window.unboundedPreceding, -1))
    within = F.pmod(F.xxhash64("_order", "_source"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    at = (F.coalesce(earlier, F.lit(0)) + within * F.col("_bytes")) / F.sum("_bytes").over(every)
    rows = rows.where(alone).withColumn("queue", own).withColumn("_at", F.lit(0.0)).unionByName(small.withColumn("_at", at))
    return rows.drop("_source", "_bytes"), ["queue", "_at", "_order", "doc_id"]


def tokenized(docs: DataFrame, path: str, end_id: int, seed: int, weighted: list[str]) -> DataFrame:
    """(range_id, doc_id, queue, before, n_tokens, ids): documents in order within their queue; `before` counts the
    queue's earlier tokens of the same range."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sent = coder(path, False, end_id), {}
        for batch in batches:
            for s, e in parts(batch.column(3), 16_000_000):
                ids = encoder.encode(batch.column(3).slice(s, e - s))
                before = []
                for queue, x in zip(batch.column(2).slice(s, e - s).to_pylist(), ids):
                    before.append(sent.get(queue, 0))
                    sent[queue] = before[-1] + len(x)
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(k).slice(s, e - s) for k in range(3)), pa.array(before, pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([x.astype(encoder.width).tobytes() for x in ids], pa.binary())], ["range_id", "doc_id", "queue", "before", "n_tokens", "ids"])

    rows, order = queued(docs, seed, weighted)
    rows = rows.repartitionByRange(parallelism(docs), *order).sortWithinPartitions(*order)
    return rows.select(F.spark_partition_id().alias("range_id"), "doc_id", "queue", "text").mapInArrow(
        run, "range_id int, doc_id bigint, queue string, before bigint, n_tokens bigint, ids binary")


def pack(docs: DataFrame, path: str | None = None, end_id: int = 1, window: int = WINDOW, granule: int = GRANULE, weights: dict[str | None, float] | None = None,
         seed: int = 7) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents in gapless windows.

    `weights` maps sources (None: the null source) to target shares (others and the default: their share of all tokens, so
    that every queue lasts to the last window). Each window takes from each queue its share to within one granule; a queue
    that runs dry leaves its share to the others. Every source has a queue of its own, except that beyond QUEUES distinct
    sources those without a weight and smaller than the QUEUES largest share QUEUES queues: such a queue takes its share as
    any other, and each of its sources is spread evenly over it, to within one of the source's documents. All windows are
    full but the last, so at most window - 1 places of the whole output are padding. Every token lies in exactly one piece.
    One row of totals per range and queue goes to the driver: a number set by the number of shuffle partitions, QUEUES and
    the weights given, not by the data.

    Null text counts as empty (one end token); a null source is a queue of its own; null or repeated doc_id and repeated
    rows are packed like any row; an empty table gives an empty result; other columns are ignored.
    """
    path = path or tokenizer_path("word_bpe_49k.json")
    weights = weights or {}
    coded = materialize(tokenized(docs, path, end_id, seed, [s for s in weights if s is not None]))
    sums = coded.groupBy("range_id", "queue").agg(F.sum("n_tokens").alias("n")).collect()
    totals: dict[str, int] = {}
    offsets: dict[tuple[int, str], int] = {}
    for range_id, queue, n in sorted(sums):
        offsets[range_id, queue] = totals.get(queue, 0)
        totals[queue] = offsets[range_id, queue] + n
    queues = sorted(totals)
    named = {f"={s}" if s is not None else "": w for s, w in weights.items()}
    tokens = sum(totals.values())
    shares = np.array([named.get(q, totals[q] / tokens) for q in queues], float)
    plan = Schedule(np.array([totals[q] for q in queues], np.int64), shares, window, granule)
    index = {q: i for i, q in enumerate(queues)}
    width = coder(path, False, end_id).width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            range_ids, queues_of = batch.column(0).to_numpy(), np.array([index[q] for q in batch.column(2).to_pylist()])
            before, sizes = (batch.column(k).to_numpy() for k in (3, 4))
            breaks = np.flatnonzero((np.diff(range_ids) != 0) | (np.diff(queues_of) != 0)) + 1
            for s, e in zip([0, *breaks.tolist()], [*breaks.tolist(), len(sizes)]):
                if s == e:
                    continue
                # documents that follow each other in a queue are one run of its tokens
                run_of, k = sizes[s:e], queues_of[s]
                total = int(run_of.sum())
                starts = np.cumsum(run_of) - run_of
                at, place = cut(*plan.segments(k, offsets[int(range_ids[s]), queues[k]] + int(before[s]), total), starts, window)
                length = np.append(at[1:], total) - at
                doc = np.searchsorted(starts, at, side="right") - 1
                ids = np.frombuffer(b"".join(batch.column(5).slice(s, e - s).to_pylist()), width).astype("<u4")
                body = memoryview(ids).cast("B")
                sums = [crc32(body[4 * a:4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays([
                    batch.column(1).slice(s, e - s).take(pa.array(doc)), pa.array(at - starts[doc]), pa.array(length), pa.array(sums, pa.int64()),
                    pa.array(run_of[doc]), pa.array(place // window), pa.array(place % window)], NAMES)

    return coded.mapInArrow(run, ", ".join(f"{name} bigint" for name in NAMES))


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
