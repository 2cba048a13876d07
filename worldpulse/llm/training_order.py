"""Operator 10, training-order materialisation of token ids; tokenising needs Python, all else is DataFrame functions.

Documents are ordered by (id, digest of the text): one exchange of the texts into sorted ranges, whose tasks tokenise
them and store their ids. A range's sequences of at most ``length`` ids are numbered by their place in it and
the totals of the ranges before it. So a sequence's number, 0 to N - 1, depends on
content alone, not on files or partitions; rows equal in both keys have equal sequences, and are spread over ranges.

A keyed Feistel network permutes the numbers: its domain is the next power of two, in two halves that take turns, and
a result of N or more is put through it again (cycle-walking) until it is below N, so
the slots are a permutation of 0 to N - 1 that anybody with key and N can compute or invert (:func:`permute`). Less than
half of the domain is above N, so a walk of ``WALK`` steps that doesn't end is not to be expected in any run; it stops the
query. One exchange deals sequences by slot into range partitions of ``SHARDS_PER_PARTITION`` shards, each sorted by slot.

A record has a fixed stride: a header (``doc_id`` as 64-bit, sequence and number of ids as 32-bit, big-endian),
the ids as little-endian unsigned 16-bit, zeros up to the stride, of which the last two bytes are always zero.
:func:`write_shards` writes a folder per ``shard_records`` records with one raw file of them, by Spark's own writer (lines that
end in a zero byte), so a task that runs again or twice leaves one file. A record's
place is hence known from its slot: shard ``slot // shard_records``, offset ``slot % shard_records`` times
the stride. A reader resumes at any slot by seeking, and reads on sequentially (:func:`read_slots`).

Ids are those of the tokenizer's own default: strings of ``special`` tokens in a text get their ids. Null and empty
texts give no sequence; an empty table no shard. Repeated rows give their sequences each. A null id is written as -1.
No text is truncated; a very long one is one row of ids, cut into its sequences before they are dealt. Extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worldpulse.llm.shared import exchanges_deleted, named, one_per_process, own_dir, small_table, store

LENGTH = 512
SHARD_RECORDS, SHARDS_PER_PARTITION = 16_384, 8
KEY = 20_240_229
ROUNDS, WALK = 8, 128
WAVES = 2
HEADER, HEADER_BYTES, END_BYTES = ">qii", 16, 2
CODED = "doc_id long, ids binary, n_tokens long, n_seq long, before long"


def stride(length: int = LENGTH) -> int:
    return HEADER_BYTES + 2 * length + END_BYTES


def _round_keys(key: int) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(struct.pack("<qI", key, r), digest_size=8).digest(), "little") >> 1 for r in range(ROUNDS)]


def _halves(n: int) -> tuple[int, int]:
    """Bits of the left and the right half of the domain of ``n`` numbers."""
    bits = max(2, (n - 1).bit_length())
    return bits // 2, bits - bits // 2


def permute(numbers: Iterable[int], n: int, key: int = KEY, inverse: bool = False) -> list[int]:
    """The slots of numbers below ``n``, for readers; with ``inverse`` the numbers of slots. :func:`slot_of` says the same to Spark."""
    left_bits, right_bits = _halves(n)
    left_mask, right_mask = (1 << left_bits) - 1, (1 << right_bits) - 1
    rounds = list(enumerate(_round_keys(key)))

    def mixed(half: int, k: int) -> int:
        # Spark's xxhash64 of two longs: the first one's hash is the second one's seed.
        return xxhash.xxh64_intdigest(struct.pack("<q", k), xxhash.xxh64_intdigest(struct.pack("<q", half), 42))

    def once(x: int) -> int:
        left, right = x >> right_bits, x & right_mask
        for r, k in rounds[::-1] if inverse else rounds:
            if r % 2:
                right ^= mixed(left, k) & right_mask
            else:
                left ^= mixed(right, k) & left_mask
        return left << right_bits | right

    out = []
    for x in map(int, numbers):
        x = once(x)
        while x >= n:
            x = once(x)
        out.append(x)
    return out


def slot_of(number: Column, n: int, key: int = KEY) -> Column:
    """The slot of a sequence's number, 0 to ``n - 1``."""
    left_bits, right_bits = _halves(n)
    left_mask, right_mask = F.lit((1 << left_bits) - 1).cast("long"), F.lit((1 << right_bits) - 1).cast("long")
    rounds = F.array(*[F.struct(F.lit(r % 2 == 1).alias("odd"), F.lit(k).cast("long").alias("key")) for r, k in enumerate(_round_keys(key))])

    def step(halves: Column, r: Column) -> Column:
        left, right = halves["left"], halves["right"]
        own = F.when(r["odd"], right.bitwiseXOR(F.xxhash64(left, r["key"]).bitwiseAND(right_mask))).otherwise(left.bitwiseXOR(F.xxhash64(right, r["key"]).bitwiseAND(left_mask)))
        return F.struct(F.when(r["odd"], left).otherwise(own).alias("left"), F.when(r["odd"], own).otherwise(right).alias("right"))

    def once(x: Column) -> Column:
        halves = F.struct(F.shiftright(x, right_bits).alias("left"), x.bitwiseAND(right_mask).alias("right"))
        return F.aggregate(rounds, halves, step, lambda h: F.shiftleft(h["left"], right_bits).bitwiseOR(h["right"]))

    # An array of one value binds it, so that nothing is worked out twice; most walks end at once, few are long.
    walked = F.array(once(number))
    for steps in (1, 7, WALK - 8):
        walked = F.transform(walked, lambda x: F.when(x < n, x).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), x, lambda y, _: F.when(y >= n, once(y)).otherwise(y))))  # noqa: B023  used at once
    failed = F.raise_error(F.lit("a walk of the permutation is too long: take another key")).cast("long")
    return F.get(F.transform(walked, lambda x: F.when(x < n, x).otherwise(failed)), F.lit(0))


def special_tokens(tokenizer_path: str) -> dict[str, int]:
    """The added tokens of a ``tokenizers`` file, by their strings."""
    with open(tokenizer_path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def _encoding(ranks: str, pattern: str, special: dict[str, int]) -> tiktoken.Encoding:
    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens=special)


def _coded(ranks: Callable[[], str], pattern: str, special: dict[str, int], length: int) -> Callable:
    """The ids of each text, its number of sequences, and how many its task holds before it."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = one_per_process(("order", ranks(), pattern, tuple(special)), lambda: _encoding(ranks(), pattern, special))
        before = 0
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = encoding.encode_to_numpy(text.as_py(), allowed_special="all").astype("<u2").tobytes() if text.is_valid else b""
                if raw:
                    n = -(-len(raw) // (2 * length))
                    rows.append((doc_id, raw, len(raw) // 2, n, before))
                    before += n
            columns = zip(*rows, strict=True) if rows else [()] * 5
            types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "ids", "n_tokens", "n_seq", "before"])

    return code


def numbered(docs: DataFrame, ranks_path: str, pattern: str, special: dict[str, int] | None = None, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """The texts' ids as a stored table ``(doc_id, ids, n_tokens, n_seq, start)``, ``start`` being the number of a text's first sequence, and how many sequences there are."""
    spark = docs.sparkSession
    with open(ranks_path, encoding="ascii") as f:
        raw = spark.sparkContext.broadcast(f.read())
    special = dict(special or {})
    if max([raw.value.count("\n"), *special.values()]) >= 65_536:
        raise ValueError("ids of 16 bits are written; this vocabulary needs more")
    path = f"{own_dir(spark)}/op10-ranges-{uuid.uuid4().hex}"
    # Equal rows are spread by the place they are read at, which changes no sequence.
    keyed = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"), F.monotonically_increasing_id().alias("place"))
    order = ["doc_id", "digest", "place"]
    ranges = keyed.withColumn("digest", F.md5("text")).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    store(ranges.mapInArrow(_coded(lambda: raw.value, pattern, special, length), CODED), path, compression="zstd")
    # A file's name begins with the number of the task that wrote it, one for each range; a task may leave several files.
    task = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("int")
    stored = spark.read.schema(CODED).parquet(path).select("*", task.alias("task"))
    starts, total = [], 0
    for r in sorted(stored.groupBy("task").agg(F.sum("n_seq").alias("n")).collect()):
        starts.append((r["task"], total))
        total += r["n"]
    offsets = F.broadcast(small_table(spark, starts, "task int, first long"))
    return stored.join(offsets, "task").select("doc_id", "ids", "n_tokens", "n_seq", (F.col("first") + F.col("before")).alias("start")), total


def _placed(found: DataFrame, total: int, key: int, shard_records: int, length: int) -> DataFrame:
    """Rows with ``number`` under their ``slot``, ``shard`` and ``offset``."""
    slots = found.withColumn("slot", slot_of(F.col("number"), total, key)).drop("number")
    shard = F.floor(F.col("slot") / shard_records).cast("int")
    return slots.withColumns({"shard": shard, "offset": (F.col("slot") % shard_records) * stride(length)})


def places(codes: DataFrame, total: int, key: int = KEY, shard_records: int = SHARD_RECORDS, length: int = LENGTH) -> DataFrame:
    """``(slot, shard, offset, doc_id, seq, n_tokens)`` of every sequence of ``codes``; the ids aren't read."""
    seq = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_seq") - 1))
    found = codes.select("doc_id", "start", "n_tokens", seq.alias("seq"))
    own = F.least(F.lit(length).cast("long"), F.col("n_tokens") - F.col("seq") * length)
    rows = found.select("doc_id", F.col("seq").cast("int").alias("seq"), own.cast("int").alias("n_tokens"), (F.col("start") + F.col("seq")).alias("number"))
    return _placed(rows, total, key, shard_records, length).select("slot", "shard", "offset", "doc_id", "seq", "n_tokens")


def in_order(codes: DataFrame, total: int, key: int = KEY, shard_records: int = SHARD_RECORDS, length: int = LENGTH, shards_per_partition: int = SHARDS_PER_PARTITION, runs: tuple[int, int] | None = None) -> DataFrame:
    """The sequences ``(slot, shard, offset, doc_id, seq, n_tokens, ids)`` of ``codes``: a partition per run of shards, sorted by slot.

    ``runs`` asks for those runs of shards only, from the first to before the second.
    """
    per = shard_records * shards_per_partition
    first, end = runs or (0, max(1, -(-total // per)))

    def placed(k: Column) -> Column:
        return F.struct(k.cast("int").alias("seq"), slot_of(F.col("start") + k, total, key).alias("slot"))

    def asked(p: Column) -> Column:
        return (p["slot"] >= first * per) & (p["slot"] < end * per)

    def cut(p: Column) -> Column:
        return F.struct(p["seq"].alias("seq"), p["slot"].alias("slot"), F.substring(F.col("ids"), 1 + 2 * length * p["seq"], F.lit(2 * length)).alias("part"))

    # The parts of a text are one array as large as the text's ids; only they go on, so a long text isn't copied for each.
    slots = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_seq") - 1), placed)
    parts = codes.select("doc_id", F.transform(F.filter(slots, asked) if runs else slots, cut).alias("parts"))
    found = parts.select("doc_id", F.inline("parts")).withColumnRenamed("part", "ids")
    shard = F.floor(F.col("slot") / shard_records).cast("int")
    own = found.select("slot", shard.alias("shard"), ((F.col("slot") % shard_records) * stride(length)).alias("offset"), "doc_id", "seq", F.floor(F.length("ids") / 2).cast("int").alias("n_tokens"), "ids")
    return own.repartitionById(end - first, F.floor(F.col("slot") / per).cast("int") - first).sortWithinPartitions("shard", "slot")


def record(length: int = LENGTH) -> Column:
    """The record of a row of :func:`in_order`, without the last of its zero bytes."""
    header = F.unhex(F.concat(F.lpad(F.hex(F.coalesce("doc_id", F.lit(-1))), 16, "0"), F.lpad(F.hex("seq"), 8, "0"), F.lpad(F.hex("n_tokens"), 8, "0")))
    return F.rpad(F.concat(header, F.col("ids")), stride(length) - 1, F.lit(b"\0"))


def write_shards(codes: DataFrame, total: int, folder: str, key: int = KEY, shard_records: int = SHARD_RECORDS, length: int = LENGTH, shards_per_partition: int = SHARDS_PER_PARTITION) -> DataFrame:
    """Write the sequences of ``codes`` as shards below ``folder``, which doesn't exist yet.

    Returns a row per sequence: its slot, shard, offset, document, and the shard's file with its size and digest, which are
    taken from the files as they were written.
    """
    spark = codes.sparkSession
    n = max(1, -(-total // (shard_records * shards_per_partition)))
    # Each wave's exchange is deleted before the next one's is made, so only a part of the ids is ever on disk a third time.
    bounds = sorted({n * w // WAVES for w in range(WAVES + 1)})
    for runs in zip(bounds, bounds[1:], strict=False):
        ordered = in_order(codes, total, key, shard_records, length, shards_per_partition, runs)
        with exchanges_deleted(spark):
            # A text writer puts a value's bytes as they are, then the line's end.
            lines = ordered.select("shard", record(length).cast("string").alias("value"))
            lines.write.mode("append").partitionBy("shard").options(lineSep="\0", maxRecordsPerFile=0).text(folder)
    if not total:
        return places(codes, total, key, shard_records, length).select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("file", "string"), ("file_bytes", "long"), ("file_sha256", "string"))])
    shard, name = F.regexp_extract("path", r"shard=(\d+)/", 1).cast("int"), F.regexp_extract("path", r"(shard=\d+/[^/]+)$", 1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder)
    known = files.select(shard.alias("shard"), name.alias("file"), F.col("length").alias("file_bytes"), F.sha2("content", 256).alias("file_sha256"))
    return places(codes, total, key, shard_records, length).join(known, "shard").select("slot", "shard", "offset", "doc_id", "seq", "n_tokens", "file", "file_bytes", "file_sha256")


def read_slots(folder: str, start: int, total: int, shard_records: int = SHARD_RECORDS, length: int = LENGTH) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """``(slot, doc_id, seq, ids)`` from slot ``start`` on, in training order; ``folder`` is a URI that pyarrow can open."""
    where, base = fs.FileSystem.from_uri(folder)
    size = stride(length)
    while start < total:
        shard, within = divmod(start, shard_records)
        file = next(f.path for f in where.get_file_info(fs.FileSelector(f"{base}/shard={shard}")) if f.base_name.startswith("part-"))
        with where.open_input_file(file) as f:
            f.seek(within * size)
            for slot in range(start, min(total, (shard + 1) * shard_records)):
                raw = f.read(size)
                doc, seq, n = struct.unpack_from(HEADER, raw)
                yield slot, doc, seq, np.frombuffer(raw, "<u2", n, HEADER_BYTES)
        start = (shard + 1) * shard_records
