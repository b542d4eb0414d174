"""WARC archives of captured pages, and the globally ordered index of what they hold.

Equal payloads are stored once: the capture with the smallest key is a response, the others revisit it. The
index is an external merge: captures are sorted in bounded runs where they are read, every run is cut at the
same bounds of (URL key, time, capture key), and a range's pieces of all runs are merged by a tree of losers.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.shared import drop_stored, fresh, map_batches, store
from glyphmill.operators.ranking import range_bucket

#: Bytes of records in a file (a longer record has more), captures in a sorted run and in a range of the index.
ARCHIVE_BYTES, RUN, RANGE = 16 << 20, 20_000, 50_000
#: Payloads that one in so many rows has are dealt over many tasks.
HOT_SHARE = 256
#: Fixed values of the format.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_KEYED, _NO_KEY = "676c7970-6b65-7920-", "676c7970-6e6f-6e65-8000-000000000000"
ENTRY = "key long, url string, captured string, record_type string, payload_bytes long, payload_digest string, refers_to long, file string, offset long, length long, sound boolean"


def base32_of_hex(digest: Column) -> Column:
    """Base32 text of a SHA-1 given in hexadecimal."""
    out = []
    for at in range(0, 40, 5):
        number = F.conv(F.substring(digest, at + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(number, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def url_key(url: Column) -> Column:
    """Host labels from the last to the first, `)`, and path with query: hosts of one domain stand together.

    Schemes, user names, ports and fragments are left out, hosts are lower-cased; a text that is no such URL is its own key.
    """
    form = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^#]*)"
    host = F.array_join(F.reverse(F.split(F.lower(F.regexp_extract(url, form, 1)), r"\.")), ",")
    return F.when(url.rlike(form), F.concat(host, F.lit(")"), F.regexp_extract(url, form, 2))).otherwise(url)


def _record_id(key: Column) -> Column:
    digits = F.lpad(F.hex(key), 16, "0")
    own = F.concat(F.lit(_KEYED), F.lower(F.substring(digits, 1, 4)), F.lit("-"), F.lower(F.substring(digits, 5, 12)))
    return F.concat(F.lit("<urn:uuid:"), F.when(key.isNull(), _NO_KEY).otherwise(own), F.lit(">"))


def record(key: Column, url: Column, captured: Column, payload: Column, digest: Column, first: Column) -> Column:
    """One record without its closing line ends: a revisit if `first`, the key of the response, is given and another key."""
    revisit = F.coalesce(first != key, first.isNotNull())
    size = F.octet_length(payload).cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    safe = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.octet_length(payload))
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", _record_id(key)),
        line("WARC-Date", captured), line("WARC-Target-URI", safe), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        line("WARC-Refers-To", F.when(revisit, _record_id(first))), line("WARC-Profile", F.when(revisit, IDENTICAL)),
        line("Content-Type", F.lit("application/http;msgtype=response")), line("Content-Length", block.cast("string")),
        F.lit("\r\n"), http, F.when(revisit, "").otherwise(payload),
    )


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", captured: str | None = None, least: int = 0, size: int = ARCHIVE_BYTES) -> None:
    """Gzipped WARC files of about `size` bytes of records in the folder `path`, one record a row.

    Of equal payloads of at least `least` bytes the row with the smallest key is the response, rows with other keys revisit it;
    rows with that key repeated are responses too. A null key comes after all others, and where there are only such rows all are responses. A null
    payload is an empty one; a null URL has no target line; `captured` is a timestamp_ntz column, and null (or no) time the start of 1970. An
    empty table makes a folder without records.

    Payloads are shuffled once, by digest; a digest that one in HOT_SHARE rows has is dealt over all tasks, with its response's key
    sent to each. The driver holds such digests alone, HOT_SHARE at most.
    """
    rows = pages.select(
        F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{payload}`"), F.lit("")).alias("payload"),
        F.rpad(F.replace(F.coalesce(F.col(f"`{captured}`").cast("string") if captured else F.lit(None).cast("string"), F.lit("1970-01-01 00:00:00")), F.lit(" "), F.lit("T")), 19, "0").alias("captured"),
    )
    rows = rows.withColumn("captured", F.concat("captured", F.lit("Z"))).withColumn("sha", F.sha1("payload"))
    long_ = F.octet_length("payload") >= least
    firsts = rows.groupBy("sha").agg(F.min(F.when(long_, F.col("key"))).alias("first"), F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("payload") + 600).alias("bytes"))
    firsts = store(firsts, "firsts")
    n, total = firsts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    parts = max(1, -(-int(total) // size))
    turns = 4 * parts  # so that files are even
    hot = [r["sha"] for r in firsts.filter((F.col("n") > 1) & (F.col("n") * HOT_SHARE > n)).select("sha").collect()]
    firsts_, on = firsts.select("sha", "first"), ["sha"]
    if hot:
        is_hot, on = F.col("sha").isin(hot), ["sha", "turn"]
        every = F.sequence(F.lit(0), F.lit(turns - 1)).cast("array<bigint>")
        rows = rows.withColumn("turn", F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(turns))).otherwise(0))
        firsts_ = firsts_.withColumn("turn", F.explode(F.when(is_hot, every).otherwise(F.array(F.lit(0).cast("bigint")))))
    met = rows.repartition(parts, *on).join(firsts_.repartition(parts, *on).hint("shuffle_hash"), on)  # the join keeps this dealing
    text = record(F.col("key"), F.col("url"), F.col("captured"), F.col("payload"), base32_of_hex(F.col("sha")), F.col("first"))
    met.select(text.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
    drop_stored(firsts)


def records_of(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header fields in lower case, block) of the records of one file, gzipped or not; offsets are those of the plain file.

    Raises ValueError where a record is not well-formed or is cut off.
    """
    file = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content))
    at = 0
    while True:
        line = file.readline()
        start = at
        while line in (b"\r\n", b"\n"):
            at += len(line)
            line, start = file.readline(), at
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins at byte {start}")
        at += len(line)
        head: dict[str, str] = {}
        while (line := file.readline()) not in (b"\r\n", b"\n", b""):
            at += len(line)
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        at += len(line)
        try:
            size = int(head["content-length"])
        except (KeyError, ValueError):
            raise ValueError(f"the record at byte {start} states no length") from None
        block = file.read(size)
        if len(block) < size:
            raise ValueError(f"the record at byte {start} is cut off")
        at += size
        yield start, at - start, head, block


def _key_of(field: str | None) -> int | None:
    m = re.fullmatch(rf"<urn:uuid:{_KEYED}([0-9a-f]{{4}})-([0-9a-f]{{12}})>", field or "")
    return int.from_bytes(bytes.fromhex(m[1] + m[2]), "big", signed=True) if m else None


def entry(head: dict[str, str], block: bytes) -> tuple:
    """key, url, captured, record_type, payload_bytes, payload_digest, refers_to, sound of a response or revisit.

    Length and digest are those of the payload that is there; a revisit has none, so its own header tells them.
    sound: the payload is what the header says.
    """
    http, _, payload = block.partition(b"\r\n\r\n")
    told = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
    stated = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if head["warc-type"] == "revisit":
        size, digest = int(told[1]) if told else None, stated
    else:
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    sound = digest == stated and (told is None or int(told[1]) == size)
    return _key_of(head.get("warc-record-id")), head.get("warc-target-uri"), head.get("warc-date", ""), head["warc-type"], size, digest, _key_of(head.get("warc-refers-to")), sound


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The ENTRY columns of every response and revisit in the WARC files of a folder; other records are passed over.

    A file is one row of one task, which streams through it: files larger than that task's memory, or than the 2 GB of a byte array, can't be read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                got = []
                for offset, length, head, block in records_of(content.as_py()):
                    if head.get("warc-type") in ("response", "revisit"):
                        *fields, sound = entry(head, block)
                        got.append((*fields, name, offset, length, sound))
                kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
                columns = [c.split() for c in ENTRY.split(", ")]
                yield pa.record_batch([pa.array([g[i] for g in got], kinds[k]) for i, (_, k) in enumerate(columns)], [c for c, _ in columns])

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "content")
    return map_batches(files, run, ENTRY)


def merged(runs: Sequence[Sequence]) -> Iterator[tuple[int, int, int]]:
    """(run, first, end): slices of sorted runs, in the order of all their items; of equal items the earlier run's come first.

    A tree of losers: each inner node keeps the run that lost there, so a new head plays one match a level. The
    winner hands over all items that come before the best loser's head at once.
    """
    size = 1
    while size < len(runs):
        size *= 2
    at = [0] * size
    head = lambda r: (0, runs[r][at[r]], r) if r < len(runs) and at[r] < len(runs[r]) else (1,)
    lost, best = [0] * size, [0] * (2 * size)
    for r in range(size):
        best[size + r] = r
    for node in range(size - 1, 0, -1):
        a, b = best[2 * node], best[2 * node + 1]
        best[node], lost[node] = (a, b) if head(a) <= head(b) else (b, a)
    winner = best[1]
    while len(first := head(winner)) > 1:
        path = [(size + winner) >> s for s in range(1, size.bit_length())]
        rival = min((head(lost[n]) for n in path), default=(1,))
        if len(rival) == 1:
            end = len(runs[winner])
        else:
            end = (bisect_right if winner < rival[2] else bisect_left)(runs[winner], rival[1], at[winner])
        yield winner, at[winner], end
        at[winner] = end
        for n in path:
            if head(lost[n]) < head(winner):
                winner, lost[n] = lost[n], winner


def capture_index(entries: DataFrame, run: int = RUN, many: int = RANGE, buckets: int = 1024) -> DataFrame:
    """`entries` with url_key and place: gapless from 0 in the order of (url_key, captured, key, file, offset), nulls first.

    Of bounded sorted runs, each cut at the bounds of `buckets` ranges at most (of about `many` captures): one range's pieces of
    all runs are merged in one task. Ranges are ranges of the whole sort key, so a URL with very many captures is cut too. No entries: no rows.
    """
    keyed = entries.withColumn("url_key", url_key(F.col("url")))
    order = ["url_key", "captured", "key", "file", "offset"]
    (part,) = fresh(keyed, "part")
    ranges = min(buckets, max(1, -(-keyed.count() // many)))
    keyed = keyed.withColumn(part, range_bucket(keyed, [F.col(c) for c in order], ranges) if ranges > 1 else F.lit(0))
    start, starts = 0, {}
    for p, n in sorted(keyed.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect()):  # a row a range
        starts[p], start = start, start + n
    columns = [c for c in keyed.columns if c != part]

    def keys(t: pa.Table) -> list[tuple]:
        return list(zip(*[[(v is not None, v) if v is not None else (False,) for v in t.column(c).to_pylist()] for c in order]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) >= run:
                yield pieces(pa.Table.from_batches(held))
                held = []
        if held:
            yield pieces(pa.Table.from_batches(held))

    def pieces(t: pa.Table) -> pa.RecordBatch:
        """A sorted run, cut where ranges end."""
        of, own = t.column(part).to_pylist(), keys(t)
        rows = sorted(range(len(own)), key=lambda i: (of[i], own[i]))
        t, of = t.select(columns).take(pa.array(rows, pa.int64())), [of[i] for i in rows]
        out, at = ([], []), 0
        while at < len(of):
            end = bisect_right(of, of[at])
            out[0].append(of[at])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema) as writer:
                writer.write_table(t.slice(at, end - at))
            out[1].append(sink.getvalue().to_pybytes())
            at = end
        return pa.record_batch([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], ["part", "piece"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        of = None
        for b in batches:
            for p, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if p != of and held:
                    yield from whole(of, held)
                    held = []
                of = p
                held.append(piece)
        if held:
            yield from whole(of, held)

    def whole(of: int, held: list[bytes]) -> Iterator[pa.RecordBatch]:
        tables = [pa.ipc.open_stream(x).read_all() for x in held]
        bases = [0]
        for t in tables:
            bases.append(bases[-1] + t.num_rows)
        rows: list[int] = []
        for r, first, end in merged([keys(t) for t in tables]):
            rows.extend(range(bases[r] + first, bases[r] + end))
        t = pa.concat_tables(tables).take(pa.array(rows, pa.int64()))
        t = t.append_column("place", pa.array(range(starts[of], starts[of] + t.num_rows), pa.int64()))
        yield from t.combine_chunks().to_batches()

    runs = map_batches(keyed.select(*columns, part), cut, "part int, piece binary")
    schema = keyed.select(*columns).schema.add("place", "long")
    return map_batches(runs.repartition("part").sortWithinPartitions("part"), merge, schema)
