"""Records of evaluation splits that also lie, exactly or nearly, in the training split.

Records are normalised, cut by content (a rolling hash over the last bytes decides where, so an insertion
moves only the cuts near it) and joined on chunk digests; a record's overlap is the share of its length in
chunks that training has too. Files and songs go the same way, with a file's hash or a song's id as the record:
equal names have equal chunks, so every one that training has comes out with an overlap of 1, and an equality
check follows. Training's digests are reduced to one row each, and the digests of more than 1/4096 of all chunks
(below 4,096) are looked up by broadcast, so a chunk that a third of the records share is never shuffled to.

Chunks cannot see similarity of vectors with noise on every component: of two vectors with a cosine of 0.99
to 1, between 0 and 13 of 88 components are equal. ``near`` therefore comes from the vantage-point search, with factor 1, which loses no pair.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from notegrain.llm.splits import split_name
from notegrain.llm.vantage import Plan, Sieve, compared, exact, index, meetings, split_copies
from notegrain.llm.vectors import key_of, name_of, unit
from notegrain.plans.shared import written

EVALUATION = ("val", "test")
WINDOW, LEAST, MOST, BITS = 8, 12, 96, 4
"""Bytes that decide a cut; least and most bytes of a chunk; one place in 2**BITS is a cut."""
_GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=4).digest(), "little") for i in range(256)], "u4")


def cuts(data: np.ndarray, start: np.ndarray, least: int = LEAST, most: int = MOST, bits: int = BITS) -> tuple[list[int], list[int]]:
    """Of records that lie one after another in ``data`` (record i from start[i] to start[i + 1]) the chunks: record and end of each."""
    h, size = np.zeros(len(data), "u4"), np.diff(start)
    inside = np.arange(len(data)) - np.repeat(start[:-1], size)
    g = _GEAR[data]
    for k in range(min(WINDOW, len(data))):
        h[k:] += np.where(inside[k:] >= k, g[: len(data) - k], 0) << np.uint32(k)
    at = np.flatnonzero((h & np.uint32((1 << bits) - 1)) == 0) + 1
    first = np.searchsorted(at, start[:-1] + 1).tolist()
    at, ends = at.tolist(), start[1:].tolist()
    row, out = [], []
    for i, (last, end) in enumerate(zip(start[:-1].tolist(), ends)):
        j = first[i]
        while end - last > least:
            while j < len(at) and at[j] < min(last + least, end):
                j += 1
            e = min(at[j] if j < len(at) else end, last + most, end)
            row.append(i)
            out.append(e)
            last = e
        if end > last:
            row.append(i)
            out.append(end)
    return row, out


def cut(data: bytes, least: int = LEAST, most: int = MOST, bits: int = BITS) -> list[int]:
    """Ends of the chunks of ``data``."""
    return cuts(np.frombuffer(data, "u1"), np.array([0, len(data)]), least, most, bits)[1]


def _chunker(batches):
    for b in batches:
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in b.column("record").to_pylist()]
        start = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype("i8")
        data = b"".join(texts)
        row, ends = cuts(np.frombuffer(data, "u1"), start)
        lows = np.maximum(np.r_[0, ends[:-1]].astype("i8"), start[row]) if row else np.empty(0, "i8")
        digest = [int.from_bytes(hashlib.blake2b(data[i:j], digest_size=8).digest(), "little", signed=True) for i, j in zip(lows.tolist(), ends)]
        at = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in ("rid", "train", "wants")], pa.array(digest, pa.int64()), pa.array(np.array(ends, "i8") - lows, pa.int64())], ["rid", "train", "wants", "digest", "size"])


def shared_lengths(records: DataFrame) -> DataFrame:
    """rid, overlap: of each record that ``wants`` it the share of its length in chunks of records that are ``train``.

    ``records`` has rid (unique, any type), record (text), train and wants (booleans, not null). Empty records have no row."""
    rid = records.schema["rid"].dataType.simpleString()
    chunks = written(records.select("rid", "train", "wants", "record").mapInArrow(_chunker, f"rid {rid}, train boolean, wants boolean, digest bigint, size bigint"), "chunks")
    counts = written(chunks.groupBy("digest").agg(F.bool_or("train").alias("hit"), F.count(F.lit(1)).alias("n")).filter("hit"), "digests")
    total = chunks.count()
    hot = F.col("n") > F.lit(total // 4096)
    mine = chunks.filter("wants").join(F.broadcast(counts.filter(hot).select("digest", F.lit(1).alias("common"))), "digest", "left")  # below 4,096 rows
    once = mine.filter("common is null").groupBy("rid", "digest").agg(F.sum("size").alias("size"))
    cold = once.join(counts.filter(~hot).select("digest", F.lit(1).alias("hit")), "digest", "left").select("rid", "size", F.when(F.col("hit") == 1, F.col("size")).otherwise(0).alias("both"))
    every = mine.filter("common is not null").select("rid", "size", F.col("size").alias("both")).unionByName(cold)
    return every.groupBy("rid").agg((F.sum("both") / F.sum("size")).alias("overlap"))


def chunk_overlap(records: DataFrame) -> DataFrame:
    """key, split, overlap: of each key of an evaluation split the largest share of a record of it that lies in
    chunks of training records. ``records`` has key, split and record (text).

    Null and empty records overlap in nothing (0). Rows without split or key are left out; equal records of a
    key count once."""
    r = records.filter("key is not null and split is not null").select("key", "split", "record").distinct().withColumn("rid", F.xxhash64("key", "split", "record"))
    wants = F.col("split").isin(*EVALUATION)
    found = shared_lengths(r.select("rid", "record", (F.col("split") == "train").alias("train"), wants.alias("wants")).filter("train or wants"))
    mine = r.filter(wants).select("key", "split", "rid").join(found, "rid", "left")
    return mine.groupBy("key", "split").agg(F.round(F.max(F.coalesce("overlap", F.lit(0.0))), 6).alias("overlap"))


def normalised(columns: list[str]) -> Column:
    """A record's text: its fields in order, without case and outer blanks; null is empty."""
    return F.concat_ws("|", *[F.coalesce(F.lower(F.trim(F.col(c).cast("string"))), F.lit("")) for c in columns])


def _reach(plan: Plan):
    def leaf(md5, x, side, flag, many, cell=None):
        train, wants = (flag & 1) > 0, (flag & 14) > 0
        if len(md5) < 2 or not train.any() or not wants.any():
            return None
        got, u = np.zeros(len(md5), bool), unit(x)
        sieve = Sieve(u, plan.least)
        # only evaluation rows meet training rows; of two blocks those of one meet those of the other
        for own, other in ((0, 1), (1, 0)) if side.min() != side.max() else ((side[0], side[0]),):
            mine, theirs = np.flatnonzero(wants & (side == own)), np.flatnonzero(train & (side == other))
            if not len(mine) or not len(theirs):
                continue
            rows, role = np.r_[mine, theirs], np.repeat([0, 1], [len(mine), len(theirs)])
            for left, right, here, there, _ in meetings(u[rows], role, plan, None if cell is None else cell[rows]):
                at, _ = sieve.pairs(left, right, rows[here], rows[there])
                p, q = rows[here[at // len(there)]], rows[there[at % len(there)]]
                if role[here[0]]:
                    p, q = q, p
                keep = (p != q) & ~got[p]
                p, q = p[keep], q[keep]
                if len(p):
                    got[p[exact(x, p, q) >= plan.least]] = True
        at = np.flatnonzero(got)
        return pa.RecordBatch.from_arrays([pa.array(md5[at], pa.binary()), pa.array(flag[at], pa.int32())], ["md5", "flag"]) if len(at) else None

    return leaf


def near(flags: DataFrame, signatures: DataFrame, least: float = 0.99, factor: float = 1.0, **sizes) -> DataFrame:
    """md5, flag of files (packed names) with an evaluation flag (2 val, 4 test) that another file with a training flag (1) is similar to."""
    plan = Plan(least, factor)
    routed = index(signatures, plan, flags, **sizes)
    core, tails = split_copies(routed, 1)
    out = "md5 binary, flag int"
    if tails is None:
        return compared(core, plan, _reach(plan), out, lone=False, **sizes).distinct()
    # a class of copies is searched as its first file, which carries the class's training flag and reports always (8)
    head = F.element_at("heads", 1)
    names = tails.select("md5", head.alias("head")).unionByName(tails.select(head.alias("md5"), head.alias("head")).distinct())
    members = written(names.join(routed.select("md5", "flag"), "md5"), "members")
    trains = members.groupBy("head").agg(F.sum(F.col("flag").bitwiseAND(1)).alias("trains"))
    mark = F.col("flag").bitwiseOR((F.col("trains") > 0).cast("int")).bitwiseOR(F.lit(8))
    core = written(core.join(trains.withColumnRenamed("head", "md5"), "md5", "left").withColumn("flag", F.when(F.col("trains").isNull(), F.col("flag")).otherwise(mark)).drop("trains"), "heads")
    hit = written(compared(core, plan, _reach(plan), out, lone=False, **sizes).distinct(), "hit")
    whole = members.join(trains, "head").join(hit.select(F.col("md5").alias("head"), F.lit(1).alias("hit")), "head", "left")
    inside = whole.filter((F.col("hit") == 1) | (F.col("trains") > F.col("flag").bitwiseAND(1))).filter("flag > 1").select("md5", "flag")
    return hit.filter(F.col("flag").bitwiseAND(8) == 0).unionByName(inside)


def cross_split(metadata: DataFrame, signatures: DataFrame, least: float = 0.99) -> DataFrame:
    """md5, split, overlap: same_file, same_song and near, for every file with a row in an evaluation split.

    Rows without md5 are left out; a null song_id is no song; files without usable vector have no near."""
    bit = F.when(F.col("s") == "train", 1).when(F.col("s") == "val", 2).when(F.col("s") == "test", 4).otherwise(0)
    rows = metadata.select("md5", "song_id", split_name().alias("s")).filter("md5 is not null")
    files = written(rows.groupBy(key_of(F.col("md5")).alias("md5")).agg(F.bit_or(bit).alias("flag"), F.collect_set("song_id").alias("songs")), "files")
    splits = lambda flag: F.explode(F.array_compact(F.array(*[F.when(F.col(flag).bitwiseAND(b) > 0, F.lit(s)) for b, s in ((2, "val"), (4, "test"))]))).alias("split")
    flagged = files.filter("flag > 0").withColumns({"train": F.col("flag").bitwiseAND(1) > 0, "wants": F.col("flag") > 1})
    keys = flagged.filter("size(songs) > 0").select("md5", "flag", "train", "wants", F.explode("songs").alias("song"))
    train = keys.filter("train").groupBy("song").agg(F.min("md5").alias("lo"), F.max("md5").alias("hi"))
    names = keys.groupBy("song").agg(F.bool_or("train").alias("train"), F.bool_or("wants").alias("wants")).select(F.struct(F.lit("song").alias("kind"), "song", F.lit(None).cast("binary").alias("md5")).alias("rid"), F.col("song").alias("record"), "train", "wants")
    hashes = flagged.select(F.struct(F.lit("file").alias("kind"), F.lit(None).cast("string").alias("song"), "md5").alias("rid"), name_of(F.col("md5")).alias("record"), "train", "wants")
    whole = written(shared_lengths(hashes.unionByName(names)).filter("overlap = 1").select("rid.*"), "whole")
    same = files.join(whole.filter("kind = 'file'").select("md5"), "md5", "left_semi").filter(F.col("flag").bitwiseAND(1) > 0).select("md5", splits("flag")).withColumn("overlap", F.lit("same_file"))
    train = train.join(whole.filter("kind = 'song'").select("song"), "song", "left_semi")
    song = keys.filter("wants").join(train, "song").filter("lo <> md5 or hi <> md5").select("md5", "flag").distinct().select("md5", splits("flag")).withColumn("overlap", F.lit("same_song"))
    close = near(files.filter("flag > 0").select("md5", "flag"), signatures, least).select("md5", splits("flag")).withColumn("overlap", F.lit("near"))
    every = same.unionByName(song).unionByName(close)
    return every.select(name_of(F.col("md5")).alias("md5"), "split", "overlap")
