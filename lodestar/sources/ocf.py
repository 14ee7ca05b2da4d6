"""Avro object container files as a Spark data source, ``format("ocf")``.

Reads any number of blocks with codec null or deflate; writes one file a partition.
Types: null, boolean, int, long, float, double, bytes, string, enum, fixed, arrays, maps,
records, and unions of null and one of these. A writer's schema is Spark's.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Callable, Iterator
from io import BytesIO
from uuid import uuid4

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

MAGIC = b"Obj\x01"
BLOCK_ROWS = 4096
MOST_BLOCK = 1 << 30


class CorruptFile(ValueError):
    """Bytes that are not a whole container file."""


def write_long(out: BytesIO, n: int) -> None:
    n = (n << 1) ^ (n >> 63)
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.write(bytes((n & 0x7F | 0x80,)))
        n >>= 7
    out.write(bytes((n,)))


class Source:
    """A cursor over bytes that refuses to read past their end."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise CorruptFile(f"{n} bytes wanted at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def long(self) -> int:
        n = shift = 0
        while True:
            b = self.take(1)[0]
            n |= (b & 0x7F) << shift
            if b < 0x80:
                break
            shift += 7
            if shift > 63:
                raise CorruptFile("a number of more than ten bytes")
        n &= (1 << 64) - 1
        return (n >> 1) ^ -(n & 1)

    def blob(self) -> bytes:
        return self.take(self.long())


def reader_of(s) -> Callable[[Source], object]:
    """A decoder for one Avro schema."""
    if isinstance(s, list):
        parts = [reader_of(x) for x in s]

        def union(src: Source):
            k = src.long()
            if not 0 <= k < len(parts):
                raise CorruptFile(f"branch {k} of a union of {len(parts)}")
            return parts[k](src)

        return union
    kind = s["type"] if isinstance(s, dict) else s
    if isinstance(kind, (dict, list)):
        return reader_of(kind)
    plain = {
        "null": lambda src: None,
        "boolean": lambda src: src.take(1) != b"\0",
        "int": Source.long,
        "long": Source.long,
        "float": lambda src: struct.unpack("<f", src.take(4))[0],
        "double": lambda src: struct.unpack("<d", src.take(8))[0],
        "bytes": Source.blob,
        "string": lambda src: src.blob().decode(),
    }
    if kind in plain:
        return plain[kind]
    if kind == "enum":
        names = s["symbols"]
        return lambda src: names[src.long()]
    if kind == "fixed":
        return lambda src: src.take(s["size"])
    if kind == "record":
        fields = [reader_of(f["type"]) for f in s["fields"]]
        return lambda src: tuple(f(src) for f in fields)
    if kind in ("array", "map"):
        item = reader_of(s["items" if kind == "array" else "values"])
        entry = item if kind == "array" else (lambda src: (src.blob().decode(), item(src)))

        def blocks(src: Source):
            got = []
            while n := src.long():
                if n < 0:
                    n = -n
                    src.long()
                if n > len(src.data):
                    raise CorruptFile("more items than bytes")
                got += [entry(src) for _ in range(n)]
            return got if kind == "array" else dict(got)

        return blocks
    raise CorruptFile(f"unknown type {kind!r}")


def writer_of(t: T.DataType, nullable: bool) -> Callable[[BytesIO, object], None]:
    """An encoder for one Spark type."""
    if nullable:
        inner = writer_of(t, False)

        def maybe(out, v):
            if v is None:
                out.write(b"\0")
            else:
                out.write(b"\2")
                inner(out, v)

        return maybe
    if isinstance(t, T.BooleanType):
        return lambda out, v: out.write(b"\1" if v else b"\0")
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return write_long
    if isinstance(t, T.FloatType):
        return lambda out, v: out.write(struct.pack("<f", v))
    if isinstance(t, T.DoubleType):
        return lambda out, v: out.write(struct.pack("<d", v))
    if isinstance(t, (T.StringType, T.BinaryType)):

        def blob(out, v):
            v = v.encode() if isinstance(v, str) else bytes(v)
            write_long(out, len(v))
            out.write(v)

        return blob
    if isinstance(t, T.ArrayType):
        item = writer_of(t.elementType, t.containsNull)

        def array(out, v):
            if v:
                write_long(out, len(v))
                for x in v:
                    item(out, x)
            out.write(b"\0")

        return array
    if isinstance(t, T.MapType):
        key, value = writer_of(T.StringType(), False), writer_of(t.valueType, t.valueContainsNull)

        def table(out, v):
            if v:
                write_long(out, len(v))
                for k, x in v.items():
                    key(out, k)
                    value(out, x)
            out.write(b"\0")

        return table
    if isinstance(t, T.StructType):
        fields = [writer_of(f.dataType, f.nullable) for f in t.fields]

        def record(out, v):
            for f, x in zip(fields, v, strict=True):
                f(out, x)

        return record
    raise TypeError(f"{t.simpleString()} has no Avro form here")


def avro_schema(t: T.DataType, nullable: bool = False, name: str = "row"):
    plain = {T.BooleanType: "boolean", T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double", T.StringType: "string", T.BinaryType: "bytes"}
    if type(t) in plain:
        s = plain[type(t)]
    elif isinstance(t, T.ArrayType):
        s = {"type": "array", "items": avro_schema(t.elementType, t.containsNull, f"{name}_item")}
    elif isinstance(t, T.MapType):
        s = {"type": "map", "values": avro_schema(t.valueType, t.valueContainsNull, f"{name}_value")}
    elif isinstance(t, T.StructType):
        s = {"type": "record", "name": name, "fields": [{"name": f.name, "type": avro_schema(f.dataType, f.nullable, f"{name}_{f.name}")} for f in t.fields]}
    else:
        raise TypeError(f"{t.simpleString()} has no Avro form here")
    return ["null", s] if nullable else s


def spark_type(s) -> tuple[T.DataType, bool]:
    """(type, nullable) of an Avro schema."""
    if isinstance(s, list):
        rest = [x for x in s if x != "null"]
        if len(rest) != 1:
            raise TypeError("only unions of null and one type are read")
        return spark_type(rest[0])[0], len(rest) < len(s)
    kind = s["type"] if isinstance(s, dict) else s
    if isinstance(kind, (dict, list)):
        return spark_type(kind)
    plain = {"null": T.NullType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType(), "enum": T.StringType(), "fixed": T.BinaryType()}
    if kind in plain:
        return plain[kind], kind == "null"
    if kind == "array":
        t, n = spark_type(s["items"])
        return T.ArrayType(t, n), False
    if kind == "map":
        t, n = spark_type(s["values"])
        return T.MapType(T.StringType(), t, n), False
    if kind == "record":
        return T.StructType([T.StructField(f["name"], *spark_type(f["type"])) for f in s["fields"]]), False
    raise TypeError(f"unknown type {kind!r}")


def read_header(src: Source) -> tuple[dict, str, bytes]:
    if src.take(4) != MAGIC:
        raise CorruptFile("no container file")
    meta = reader_of({"type": "map", "values": "bytes"})(src)
    codec = meta.get("avro.codec", b"null").decode()
    if codec not in ("null", "deflate"):
        raise CorruptFile(f"unknown codec {codec!r}")
    return json.loads(meta["avro.schema"]), codec, src.take(16)


def read_file(data: bytes) -> Iterator[tuple]:
    src = Source(data)
    schema, codec, sync = read_header(src)
    decode = reader_of(schema)
    while src.at < len(data):
        n, size = src.long(), src.long()
        if n < 0 or size < 0 or size > MOST_BLOCK:
            raise CorruptFile("a negative count or an impossible size")
        block = src.take(size)
        if codec == "deflate":
            block = zlib.decompress(block, -15)
        if src.take(16) != sync:
            raise CorruptFile("a block does not end in the file's marker")
        own = Source(block)
        for _ in range(n):
            yield decode(own)
        if own.at != len(block):
            raise CorruptFile("bytes left over in a block")


def write_file(rows: Iterator, schema: T.StructType, codec: str = "deflate") -> bytes:
    out, sync, encode = BytesIO(), uuid4().bytes, writer_of(schema, False)
    out.write(MAGIC)
    head = {"avro.schema": json.dumps(avro_schema(schema)).encode(), "avro.codec": codec.encode()}
    writer_of(T.MapType(T.StringType(), T.BinaryType(), False), False)(out, head)
    out.write(sync)
    block, n = BytesIO(), 0

    def flush() -> None:
        body = block.getvalue()
        if codec == "deflate":
            z = zlib.compressobj(1, zlib.DEFLATED, -15)
            body = z.compress(body) + z.flush()
        write_long(out, n)
        write_long(out, len(body))
        out.write(body + sync)

    for row in rows:
        encode(block, row)
        n += 1
        if n == BLOCK_ROWS:
            flush()
            block, n = BytesIO(), 0
    if n:
        flush()
    return out.getvalue()


def _files(path: str) -> list[str]:
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if not f.startswith(("_", ".")))
    return [path]


class OcfSource(DataSource):
    """``spark.read.format("ocf").load(path)`` on a file system that every executor mounts."""

    @classmethod
    def name(cls) -> str:
        return "ocf"

    def schema(self) -> T.StructType:
        with open(_files(self.options["path"])[0], "rb") as f:
            return spark_type(read_header(Source(f.read(1 << 20)))[0])[0]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema, self.options.get("codec", "deflate"), overwrite)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in _files(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            yield from read_file(f.read())


class _Writer(DataSourceWriter):
    def __init__(self, path: str, schema: T.StructType, codec: str, overwrite: bool):
        self.path, self.schema, self.codec, self.overwrite = path.removeprefix("file://"), schema, codec, overwrite
        self.was = _files(self.path) if overwrite and os.path.isdir(self.path) else []

    def write(self, rows: Iterator) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        name = os.path.join(self.path, f".{uuid4().hex}.avro")
        with open(name, "wb") as f:
            f.write(write_file(rows, self.schema, self.codec))
        out = WriterCommitMessage()
        out.name = name
        return out

    def commit(self, messages: list) -> None:
        for old in self.was:
            os.remove(old)
        for k, m in enumerate(m for m in messages if m is not None):
            os.replace(m.name, os.path.join(self.path, f"part-{k:05d}-{os.path.basename(m.name)[1:]}"))

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.name):
                os.remove(m.name)
