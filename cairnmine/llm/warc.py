"""WARC archives: written by Spark's text sink, read back by boundary-chain verification.

Writing. A record is a header block and the page's HTML; the text sink writes its bytes and ends it with CR LF CR LF.
Pages with equal payloads share one response record (the largest page id); the others are revisit records that name it
and carry no payload, but the digest and length of the full one. All of it is native: digest, base32 and record text
are column expressions, and only groups with more than one page are joined back.

Reading. The text source splits archives at every ``WARC/1.1`` line, also those inside payloads, so every piece is a
candidate record. Tasks know a piece's place inside their file split only; totals by split give the splits' offsets.
A candidate with a well-formed header points to its successor, at its own offset plus the declared length. Inside a
split the chains are contracted to where they leave it; pointer jumping over splits from each file's start finds which
candidates are entered, and what is not on a chain from the start (magic inside a payload) is rejected. Digests are
computed while a piece is read; a record that its payload's own magic cut into pieces is put together in a second pass
over those pieces only.

Defined cases: a null html is an empty payload; a null page id or url is left out of the header (a null id reads back as
null) and counts as smaller than any id; rows that share page id and payload are all response or all revisit. A file
that is cut off loses its last record; a broken header ends its file's chain, as no later offset can be trusted.
Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import Scratch, per_key

#: Fixed values of the format.
MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE, BIN = "2024-01-01T00:00:00Z", 1 << 20


def base32_sha1(sha1_hex: Column) -> Column:
    """Base32 of a digest in hexadecimal: five hex digits give four letters."""
    letters = []
    for i in range(8):
        v = F.conv(F.substring(sha1_hex, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _header(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def records(pages: DataFrame, scratch: Scratch, least: int = 0) -> DataFrame:
    """(value): each page's record without its end."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace("url", "[\r\n]", "").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"))
    groups = rows.where(F.octet_length("html") >= least).groupBy("sha1").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha1", "first")
    rows = rows.join(scratch.write(groups, "groups"), "sha1", "left")
    first = F.when(F.octet_length("html") >= least, F.col("first"))
    revisit = F.coalesce(first != F.coalesce("page_id", F.lit(-(1 << 63))), F.lit(False))
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    head = F.concat(
        F.lit(MAGIC), F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), F.lit("\r\n"), _header("WARC-Record-ID", record_id(F.col("page_id"))), _header("WARC-Date", F.lit(DATE)), _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("sha1")))), _header("WARC-Refers-To", F.when(revisit, record_id(first))), _header("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        _header("X-Payload-Length", F.when(revisit, F.octet_length("html"))), _header("Content-Type", F.lit("text/html; charset=utf-8")), _header("Content-Length", F.octet_length(body)), F.lit("\r\n"),
    )
    return rows.select(F.concat(head, body).alias("value"))


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    records(pages, Scratch(pages.sparkSession), least).write.option("lineSep", END).text(path)


_HEAD = re.compile(rb"(?:[!-9;-~]+:[^\r\n]*\r\n)+\r\n")
_LENGTH = re.compile(rb"(?:\A|\r\n)Content-Length:[ \t]*([0-9]{1,18})[ \t]*\r\n", re.I)
_FIELDS = {k: re.compile(rb"(?:\A|\r\n)" + v + rb":[ \t]*([^\r\n]*)\r\n", re.I) for k, v in (("record_type", b"WARC-Type"), ("record_id", b"WARC-Record-ID"), ("url", b"WARC-Target-URI"), ("refers", b"WARC-Refers-To"), ("digest", b"WARC-Payload-Digest"), ("full", b"X-Payload-Length"))}
_PIECE = T.StructType([T.StructField("file", T.StringType()), T.StructField("block", T.LongType()), T.StructField("rel", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("step", T.LongType()), T.StructField("head", T.LongType())] + [T.StructField(k, T.StringType()) for k in _FIELDS] + [T.StructField("whole", T.BooleanType()), T.StructField("payload_digest", T.StringType())])


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each piece is as a candidate. ``rel``: where it begins, counted from the first piece of its file split."""
    at: tuple | None = None
    rel = 0
    for b in batches:
        rows = []
        for file, block, value in zip(b.column("file").to_pylist(), b.column("block").to_pylist(), b.column("value")):
            if (file, block) != at:
                at, rel = (file, block), 0
            raw = value.as_py()
            head = _HEAD.match(raw)
            length = _LENGTH.search(raw, 0, head.end() - 2) if head else None
            if length:
                n, k = int(length[1]), head.end()
                step = len(MAGIC) + k + n + len(END)
                found = {name: (m[1].decode("utf-8", "replace") if (m := p.search(raw, 0, k - 2)) else None) for name, p in _FIELDS.items()}
                whole = len(raw) >= k + n + len(END) and raw[k + n : k + n + len(END)] == END.encode()
                rows.append((file, block, rel, len(raw) + len(MAGIC), step, k, *found.values(), whole, digest_of(raw[k : k + n]) if whole else None))
            else:
                rows.append((file, block, rel, len(raw) + len(MAGIC), None, None, *[None] * (len(_FIELDS) + 2)))
            rel += len(raw) + len(MAGIC)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.string(), *[pa.int64()] * 5, *[pa.string()] * len(_FIELDS), pa.bool_(), pa.string()])], _PIECE.names)


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): the text between one magic and the next, in order inside a split."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _contract(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
    """Where the chain from each candidate leaves its split (``exit``; itself if its header is broken)."""
    for t in tables:
        t = t.sort_by([("key", "ascending"), ("file", "ascending"), ("block", "ascending"), ("at", "ascending")])
        out = []
        group: list = []
        for file, block, at, nxt in zip(t.column("file").to_pylist(), t.column("block").to_pylist(), t.column("at").to_pylist(), t.column("next").to_pylist()):
            if group and group[0][:2] != (file, block):
                out += _exits(group)
                group = []
            group.append((file, block, at, nxt))
        out += _exits(group)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.string(), pa.int64(), pa.int64()])], ["file", "at", "exit"])


def _exits(group: list) -> list:
    last = group[-1][2]
    exits: dict[int, int | None] = {}
    for _, _, at, nxt in reversed(group):
        exits[at] = None if nxt is None else nxt if nxt > last else exits.get(nxt)  # None: the chain ends here
    return [(file, at, exits[at]) for file, _, at, _ in group]


def _walk(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
    """The candidates on chains that begin where a split was entered."""
    for t in tables:
        t = t.sort_by([("file", "ascending"), ("block", "ascending"), ("at", "ascending")])
        out, want, own = [], set(), None
        for file, block, at, nxt, entered in zip(*[t.column(c).to_pylist() for c in ("file", "block", "at", "next", "entered")]):
            if (file, block) != own:
                want, own = set(), (file, block)
            if entered or at in want:
                out.append((file, at))
                if nxt is not None:
                    want.add(nxt)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.string(), pa.int64()])], ["file", "at"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, record_type, record_id, url, refers, digest, payload_bytes, payload_digest) of every record on its file's chain."""
    scratch = Scratch(spark)
    pieces = scratch.write(_scan(spark, path).mapInArrow(_pieces, _PIECE), "pieces")
    totals = pieces.groupBy("file", "block").agg(F.sum("bytes").alias("b"))
    before = F.coalesce(F.sum("b").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = scratch.write(totals.select("file", "block", before.alias("start")), "starts")
    # the first piece of a file is what stands before its first magic; a piece's offset is that of its own magic
    placed = pieces.join(starts, ["file", "block"]).withColumn("at", F.col("start") + F.col("rel") - len(MAGIC)).withColumn("next", F.col("at") + F.col("step"))
    placed = scratch.write(placed.where("at >= 0 and step is not null"), "placed")
    key = F.xxhash64("file", "block").alias("key")
    jump = scratch.write(per_key(placed.select(key, "file", "block", "at", "next"), "key", _contract, "file string, at long, exit long").where("exit is not null"), "jump")
    entered = scratch.write(placed.where("at = 0").select("file", "at"), "entered")
    n = entered.count()
    while True:  # pointer jumping: paths of 1, 2, 4 ... splits
        more = entered.unionByName(entered.join(jump, ["file", "at"]).select("file", F.col("exit").alias("at"))).distinct()
        entered = scratch.write(more, "entered")
        if (m := entered.count()) == n:
            break
        n = m
        two = jump.alias("x").join(jump.alias("y"), (F.col("x.file") == F.col("y.file")) & (F.col("x.exit") == F.col("y.at")), "left")
        jump = scratch.write(jump.unionByName(two.where("y.exit is not null").select("x.file", "x.at", F.col("y.exit").alias("exit"))).groupBy("file", "at").agg(F.max("exit").alias("exit")), "jump")
    marked = placed.join(entered.withColumn("entered", F.lit(True)), ["file", "at"], "left").select(key, "file", "block", "at", "next", F.coalesce("entered", F.lit(False)).alias("entered"))
    real = scratch.write(per_key(marked, "key", _walk, "file string, at long"), "real")
    found = placed.join(real, ["file", "at"])
    fields = ["file", "at", "record_type", "record_id", "url", "refers", "digest", "full"]
    length = (F.col("step") - F.col("head") - len(MAGIC) - len(END)).alias("length")
    whole = found.where("whole").select(*fields, length, "payload_digest")
    cut = scratch.write(found.where("not whole").select(*fields, "head", length), "cut")
    if cut.limit(1).count():
        whole = whole.unionByName(_joined(spark, path, starts, cut, fields))
    of = F.when(F.col("record_type") == "revisit", F.col("full").cast("long")).otherwise(F.col("length"))
    digest = F.when(F.col("record_type") == "revisit", F.regexp_replace("digest", "^sha1:", "")).otherwise(F.col("payload_digest"))
    return whole.select("file", "at", "record_type", "record_id", "url", "refers", F.regexp_replace("digest", "^sha1:", "").alias("digest"), of.alias("payload_bytes"), digest.alias("payload_digest"))


def _joined(spark: SparkSession, path: str, starts: DataFrame, cut: DataFrame, fields: list[str]) -> DataFrame:
    """Payloads that magic cut into pieces, put together from the pieces that they cover."""
    offsets = _scan(spark, path).mapInArrow(_offsets, "file string, block long, rel long, value binary")
    offsets = offsets.join(starts, ["file", "block"]).withColumn("p_at", F.col("start") + F.col("rel") - len(MAGIC)).where("p_at >= 0").select(F.col("file").alias("p_file"), "p_at", "value")
    end = F.col("at") + len(MAGIC) + F.col("head") + F.col("length")
    wide = cut.withColumn("end", end).withColumn("bin", F.explode(F.sequence(F.expr(f"at div {BIN}"), F.expr(f"end div {BIN}"))))
    parts = offsets.withColumn("p_bin", F.expr(f"p_at div {BIN}")).join(wide.select("file", "at", "end", "bin"), (F.col("p_file") == F.col("file")) & (F.col("p_bin") == F.col("bin")) & (F.col("p_at") >= F.col("at")) & (F.col("p_at") < F.col("end")))
    joined = parts.groupBy("file", "at").agg(F.sort_array(F.collect_list(F.struct("p_at", "value"))).alias("p"))  # bounded by one record
    raw = F.aggregate("p", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, F.lit(MAGIC.encode()), x["value"]))
    out = cut.join(joined.select("file", "at", raw.alias("raw")), ["file", "at"])
    whole = F.expr(f"length(raw) >= {len(MAGIC)} + head + length + {len(END)}") & (F.expr(f"substring(raw, {len(MAGIC)} + head + length + 1, {len(END)})") == F.lit(END.encode()))
    return out.where(whole).select(*fields, "length", base32_sha1(F.sha1(F.expr(f"substring(raw, cast({len(MAGIC)} + head + 1 as int), cast(length as int))"))).alias("payload_digest"))


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, rel = None, 0
    for b in batches:
        size = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in b.column("value")], np.int64) + len(MAGIC)
        rels = []
        for key, n in zip(zip(b.column("file").to_pylist(), b.column("block").to_pylist()), size.tolist()):
            if key != own:
                own, rel = key, 0
            rels.append(rel)
            rel += n
        yield pa.RecordBatch.from_arrays([b.column("file"), b.column("block"), pa.array(rels, pa.int64()), b.column("value")], ["file", "block", "rel", "value"])


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes the archive, reads it back: (page_id, payload_bytes, payload_digest, record_type, refers_to, url)."""
    spark = pages.sparkSession
    path = Scratch(spark).path("warc")
    write(pages, path, least)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    out = read(spark, path)
    return out.select(F.when(number("record_id") != "", number("record_id").cast("long")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(number("refers") != "", number("refers").cast("long")).alias("refers_to"), "url")
