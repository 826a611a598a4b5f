"""WARC archives: write, normalise and read back.

A page becomes a ``response`` record, or a ``revisit`` of the record that holds the same payload. Archives are
first written as one gzip stream per file. The normaliser inflates each such file once, from front to back,
writes every record as a gzip member of its own and beside the file an index of offsets, by which single records
can be read. Files go to the shared folder; each attempt of a task writes files of its own name, and only those
named in the table that the finished job wrote are used, so repeated tasks and lost executors leave no trace in the result.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane.llm.common import new_folder, stored

SMALLEST = 100
FILE_BYTES = 64 << 20
READ_BYTES = 1 << 20
MOST_TASKS = 20_000
DATE = "2024-01-01T00:00:00Z"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def record_name(page_id: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id}/{digest}')}>"


def record(page_id: str | None, payload: bytes, digest: str, first: str | None) -> bytes:
    """One WARC record; ``first``: the page whose payload it repeats, if any."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_name(page_id, digest)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if page_id is not None:
        head += [f"WARC-Target-URI: urn:page:{page_id}"]
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_name(first, digest)}", f"WARC-Refers-To-Target-URI: urn:page:{first}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}


def records_in(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Cut a stream of inflated bytes into its records."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        while (end := held.find(b"\r\n\r\n")) >= 0:
            size = end + 4 + int(fields_of(bytes(held[:end]))["content-length"]) + 4
            if len(held) < size:
                break
            yield bytes(held[:size])
            del held[:size]
    if held:
        raise ValueError("the archive ends inside a record")


def inflated(source) -> Iterator[bytes]:
    """Inflate a gzip file once, whatever members it has, in bounded pieces."""
    inflate = zlib.decompressobj(31)
    while data := source.read(READ_BYTES):
        while data:
            yield inflate.decompress(data, READ_BYTES)
            while inflate.unconsumed_tail:
                yield inflate.decompress(inflate.unconsumed_tail, READ_BYTES)
            data = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write page_id, payload, digest, first (texts) as whole-file gzip archives; returns (path, records)."""

    def write(batches):
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        context, part, sink = TaskContext.get(), 0, None
        paths, counts, written = [], [], 0
        for batch in batches:
            for page_id, payload, digest, first in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if sink is None:
                    name = f"{context.partitionId()}-{context.taskAttemptId()}-{part}.warc.gz"
                    sink, pack, written, part = system.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, 31), 0, part + 1
                    paths.append(f"{folder}/{name}")
                    counts.append(0)
                whole = record(page_id, payload.encode(), digest, first)
                sink.write(pack.compress(whole))
                counts[-1] += 1
                written += len(whole)
                if written >= file_bytes:
                    sink.write(pack.flush())
                    sink.close()
                    sink = None
        if sink is not None:
            sink.write(pack.flush())
            sink.close()
        yield pa.record_batch([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], ["path", "records"])

    return stored(pages.select("page_id", "payload", "digest", "first").mapInArrow(write, "path string, records long"), "warc-written")


def one_by_one(archives: DataFrame) -> DataFrame:
    """A task for each archive, up to ``MOST_TASKS``: paths are short, so left to their size they would all meet in one task."""
    return archives.repartition(max(1, min(MOST_TASKS, archives.count())))


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive of ``path`` with a gzip member per record and an index; returns (path, index, records).

    The index has a line per record: offset, length, type and name, parted by tabs.
    """

    def rewrite(batches):
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            out: list[tuple[str, str, int]] = []
            for path in batch["path"]:
                source_system, source = file_system(path)
                name = f"{source.rsplit('/', 1)[-1].removesuffix('.warc.gz')}-{attempt}.warc.gz"
                lines, offset = [], 0
                with source_system.open_input_stream(source, compression=None) as raw, system.open_output_stream(f"{root}/{name}", compression=None) as sink:
                    for whole in records_in(inflated(raw)):
                        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = pack.compress(whole) + pack.flush()
                        sink.write(member)
                        about = fields_of(whole[: whole.index(b"\r\n\r\n")])
                        lines.append(f"{offset}\t{len(member)}\t{about['warc-type']}\t{about['warc-record-id']}\n")
                        offset += len(member)
                with system.open_output_stream(f"{root}/{name}.idx", compression=None) as sink:
                    sink.write("".join(lines).encode())
                out.append((f"{folder}/{name}", f"{folder}/{name}.idx", len(lines)))
            yield pd.DataFrame(out, columns=["path", "index", "records"])

    return stored(one_by_one(archives).mapInPandas(rewrite, "path string, index string, records long"), "warc-normalised")


def read_record(member: bytes) -> tuple[str | None, int, str, str, str | None]:
    """Page id, payload bytes, payload digest, type and the page referred to, of one gzip member."""
    whole = zlib.decompress(member, 31)
    end = whole.index(b"\r\n\r\n")
    about = fields_of(whole[:end])
    block = whole[end + 4 : end + 4 + int(about["content-length"])]
    http = block.index(b"\r\n\r\n")
    size, digest = int(fields_of(block[:http])["content-length"]), about["warc-payload-digest"].removeprefix("sha256:")
    page = lambda field: about[field].removeprefix("urn:page:") if field in about else None
    if about["warc-type"] == "response":
        payload = block[http + 4 :]
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"the payload of {about['warc-record-id']} is damaged")
    return page("warc-target-uri"), size, digest, about["warc-type"], page("warc-refers-to-target-uri")


def read_archives(archives: DataFrame) -> DataFrame:
    """All records of normalised archives, each read by its place in the index."""

    def read(batches):
        for batch in batches:
            for path, index in zip(batch["path"], batch["index"]):
                system, place = file_system(path)
                with system.open_input_stream(file_system(index)[1]) as lines:
                    places = [tuple(map(int, line.split("\t")[:2])) for line in lines.read().decode().splitlines()]
                with system.open_input_file(place) as source:
                    for i in range(0, len(places), 1000):
                        found = [read_record(source.read_at(length, offset)) for offset, length in places[i : i + 1000]]
                        yield pd.DataFrame(found, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return one_by_one(archives).mapInPandas(read, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def archived(df: DataFrame, page_id: str = "page_id", html: str = "html", smallest: int = SMALLEST, folder: str | None = None) -> DataFrame:
    """Write a record per page, normalise the archives, and return what reading them back gives.

    page_id, payload_bytes, payload_digest, record_type, refers_to. A null html is an empty payload. Of equal
    payloads of at least ``smallest`` bytes, the rows with the smallest page_id are responses and all others
    revisits of it; shorter ones are responses. Where no page of a group has an id, all are responses. Repeated
    rows have a record each. An empty table gives an empty result.
    """
    spark: SparkSession = df.sparkSession
    kind = df.schema[page_id].dataType
    root = folder or new_folder(spark, "warc")
    pages = df.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(html), F.lit("")).alias("payload")).withColumn("digest", F.sha2(F.encode("payload", "UTF-8"), 256))
    big = F.octet_length("payload") >= smallest
    repeated = pages.where(big).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("digest", "least")
    first = F.when(big & (F.col("page_id").isNull() | (F.col("page_id") != F.col("least"))), F.col("least"))
    # what can have no partner is spread by its own id: else all empty pages would meet at one digest
    alone = F.concat(F.lit("alone-"), F.xxhash64("page_id", "digest", "payload").cast("string"))
    named = pages.withColumn("met", F.when(big, F.col("digest")).otherwise(alone)).join(repeated.withColumnRenamed("digest", "met"), "met", "left").select(F.col("page_id").cast("string"), "payload", "digest", first.cast("string").alias("first"))
    written = write_archives(named, f"{root}/whole")
    out = read_archives(normalise(written, f"{root}/records"))
    return out.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))
