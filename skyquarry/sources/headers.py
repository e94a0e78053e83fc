"""Headers of FITS and XISF files as rows, without their pixels.

`read_headers` takes a DataFrame of paths that the executors can open; `HeaderSource` is the same as a Data Source ("frame_headers").
Unreadable files give one row with an error and no image, so no task fails.
"""

from __future__ import annotations

import glob
import gzip
import os
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import dataset
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith

SCHEMA = "path string, format string, hdu int, is_image boolean, bitpix int, naxis int, naxis1 long, naxis2 long, cards array<struct<keyword:string,value:string,comment:string>>, error string"
BLOCK = 2880
XISF_MAGIC = b"XISF0100"
MAX_XISF_HEADER = 64 << 20
#: Bits per pixel of XISF sample formats, negative for floating point.
SAMPLES = {"UInt8": 8, "UInt16": 16, "UInt32": 32, "UInt64": 64, "Float32": -32, "Float64": -64}
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


class HeaderError(ValueError):
    """The file has no readable header."""


def clean_value(text: str) -> str:
    """A card's value: quotes off, doubled quotes single, blanks at the end off."""
    t = text.strip()
    if t.startswith("'"):
        m = re.match(r"'((?:[^']|'')*)'?", t)
        return m[1].replace("''", "'").rstrip()
    return t.split("/", 1)[0].strip()


def parse_card(card: str) -> tuple[str, str, str]:
    """(keyword, value, comment) of an 80-character card."""
    keyword, rest = card[:8].strip(), card[8:]
    if keyword == "HIERARCH" and "=" in rest:  # the keyword is all before the equals sign
        keyword, rest = rest.split("=", 1)[0].strip(), "= " + rest.split("=", 1)[1]
    if not rest.startswith("= "):
        return keyword, rest.strip(), ""
    body = rest[2:]
    m = re.match(r"\s*('(?:[^']|'')*'|[^/]*)\s*(?:/(.*))?$", body)
    return keyword, clean_value(m[1] if m else body), (m[2] or "").strip() if m else ""


def read_fits(f) -> list[dict]:
    """All header units, in order: geometry and cards. Data are skipped by their size."""
    units = []
    while True:
        first = f.read(BLOCK)
        if not first.strip(b"\0 "):
            break
        if len(first) < BLOCK or not (first.startswith(b"SIMPLE") if not units else first.startswith(b"XTENSION")):
            if units:
                break
            raise HeaderError("not a FITS file")
        text, done = first, b"END" + b" " * 77
        while not any(text[i : i + 80] == done for i in range(len(text) - BLOCK, len(text), 80)):
            more = f.read(BLOCK)
            if len(more) < BLOCK:
                raise HeaderError("header without end")
            text += more
        cards = []
        for i in range(0, len(text), 80):
            card = text[i : i + 80].decode("ascii", "replace")
            if card.startswith("END") and not card[3:].strip():
                break
            if card.strip():
                cards.append(parse_card(card))
        known = {}
        for k, v, _ in cards:
            known.setdefault(k, v)

        def number(key: str, default: int = 0, known=known) -> int:
            try:
                return int(float(known.get(key, default)))
            except ValueError:
                return default

        naxis = number("NAXIS")
        axes = [number(f"NAXIS{i}") for i in range(1, naxis + 1)]
        kind = known.get("XTENSION", "IMAGE")
        compressed = known.get("ZIMAGE", "").upper() == "T"
        shown = [number(f"ZNAXIS{i}") for i in range(1, number("ZNAXIS") + 1)] if compressed else axes
        units.append({"hdu": len(units), "is_image": (kind == "IMAGE" or compressed) and len(shown) > 0, "bitpix": number("ZBITPIX" if compressed else "BITPIX"), "naxis": len(shown), "naxis1": shown[0] if shown else 0, "naxis2": shown[1] if len(shown) > 1 else 0, "cards": cards})
        size = abs(number("BITPIX")) // 8 * number("GCOUNT", 1)
        elements = 1 if axes else 0
        for a in axes:
            elements *= a
        total = size * (number("PCOUNT") + elements)
        f.seek(-(-total // BLOCK) * BLOCK, os.SEEK_CUR)
    if not units:
        raise HeaderError("empty file")
    return units


def _entities(text: str) -> str:
    return re.sub("|".join(ENTITIES), lambda m: ENTITIES[m[0]], text)


def attribute(tag: str, name: str) -> str | None:
    """An attribute of a tag, in either kind of quotes."""
    m = re.search(rf"(?<![\w:.-]){re.escape(name)}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", tag)
    return None if not m else _entities(m[1] if m[1] is not None else m[2])


def read_xisf(f) -> list[dict]:
    """One unit for each image of the XML header; keywords belong to the image that encloses them."""
    if f.read(8) != XISF_MAGIC:
        raise HeaderError("not an XISF file")
    size = struct.unpack("<I", f.read(4))[0]
    f.read(4)
    if not 0 < size <= MAX_XISF_HEADER:
        raise HeaderError("header size out of range")
    data = f.read(size)
    if len(data) < size:
        raise HeaderError("header cut short")
    xml = re.sub(r"<!--.*?-->", "", data.rstrip(b"\0").decode("utf-8", "replace"), flags=re.S)
    units, current = [], None
    for m in re.finditer(r"<(/?)(Image|FITSKeyword)\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", xml):
        closing, name, body = m.groups()
        if name == "Image":
            current = None
            if not closing:
                parts = [int(x) for x in (attribute(body, "geometry") or "").split(":") if x.isdigit()]
                dims, channels = parts[:-1], parts[-1] if parts else 0
                naxis = 3 if len(parts) >= 3 and channels > 1 else min(2, len(dims))
                current = {"hdu": len(units), "is_image": naxis > 0, "bitpix": SAMPLES.get(attribute(body, "sampleFormat"), 0), "naxis": naxis, "naxis1": dims[0] if dims else 0, "naxis2": dims[1] if len(dims) > 1 else 0, "cards": []}
                current["cards"] += [(k, str(current[v]), "") for k, v in (("NAXIS", "naxis"), ("NAXIS1", "naxis1"), ("NAXIS2", "naxis2"))]
                units.append(current)
                if body.rstrip().endswith("/"):
                    current = None
        elif current is not None and not closing:
            key = attribute(body, "name")
            if key:
                current["cards"].append((key, clean_value(attribute(body, "value") or ""), attribute(body, "comment") or ""))
    if not units:
        raise HeaderError("no image")
    return units


def read_file(path: str) -> list[dict]:
    """The rows of one file."""
    local = re.sub(r"^file:/+", "/", path)
    form = "xisf" if re.search(r"(?i)\.xisf$", local) else "fits"
    empty = {"path": path, "format": form, "hdu": None, "is_image": False, "bitpix": None, "naxis": None, "naxis1": None, "naxis2": None, "cards": [], "error": None}
    try:
        with gzip.open(local) if local.lower().endswith(".gz") else open(local, "rb") as f:
            magic = f.read(8)
            f.seek(0)
            form = "xisf" if magic == XISF_MAGIC or form == "xisf" else "fits"
            units = read_xisf(f) if form == "xisf" else read_fits(f)
        return [empty | {"format": form} | u | {"cards": [dict(zip(("keyword", "value", "comment"), c)) for c in u["cards"]]} for u in units]
    except (OSError, HeaderError, struct.error, EOFError) as e:
        return [empty | {"error": str(e)[:500]}]


def _batch(rows: list[dict]) -> pa.RecordBatch:
    card = pa.struct([("keyword", pa.string()), ("value", pa.string()), ("comment", pa.string())])
    kinds = {"path": pa.string(), "format": pa.string(), "hdu": pa.int32(), "is_image": pa.bool_(), "bitpix": pa.int32(), "naxis": pa.int32(), "naxis1": pa.int64(), "naxis2": pa.int64(), "cards": pa.list_(card), "error": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))


def read_headers(paths: DataFrame) -> DataFrame:
    """One row for each header unit of the files in column `path`; only header blocks are read."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                yield _batch([r for p in batch.column("path").slice(i, 64).to_pylist() for r in read_file(p)])

    return paths.select("path").mapInArrow(run, SCHEMA)


class _Part(InputPartition):
    """Paths to read, or a piece of the table of paths: a file and one of its row groups."""

    def __init__(self, paths: list[str], file: str = "", group: int = 0):
        self.paths, self.file, self.group = paths, file, group


#: Filters on the path that the reader applies by itself, before a file is opened.
_ON_PATH = {
    EqualTo: lambda p, v: p == v, GreaterThan: lambda p, v: p > v, GreaterThanOrEqual: lambda p, v: p >= v, LessThan: lambda p, v: p < v, LessThanOrEqual: lambda p, v: p <= v,
    In: lambda p, v: p in v, StringStartsWith: lambda p, v: p.startswith(v),
}


class _Reader(DataSourceReader):
    """Lists files below `path`, or takes them from `listing`, a Parquet table with a column `path` (such as what `walk` gives), which the tasks read."""

    def __init__(self, options: dict):
        self.folder, self.listing, self.per = options.get("path"), options.get("listing"), int(options.get("filesPerPartition", 500))
        self.images, self.tests = False, []

    def wanted(self, path: str) -> bool:
        return all(_ON_PATH[kind](path, value) for kind, value in self.tests)

    def partitions(self):
        if self.listing:
            pieces = dataset.dataset(self.listing, format="parquet").get_fragments()
            return [_Part([], f.path, g.id) for f in pieces for g in f.row_groups] or [_Part([])]
        found = sorted(p for p in glob.glob(os.path.join(self.folder, "**"), recursive=True) if re.search(r"(?i)\.(fits?|fts|fz|xisf)(\.gz)?$", p) and self.wanted(p))
        return [_Part(found[i : i + self.per]) for i in range(0, len(found), self.per)] or [_Part([])]

    def paths(self, partition: _Part) -> list[str]:
        if not partition.file:
            return partition.paths
        piece = next(f for f in dataset.dataset(self.listing, format="parquet").get_fragments() if f.path == partition.file)
        found = piece.subset(row_group_ids=[partition.group]).to_table(columns=["path"]).column("path").to_pylist()
        return [p for p in found if p is not None and self.wanted(p)]

    def read(self, partition):
        paths = self.paths(partition)
        for i in range(0, len(paths), 64):
            rows = [r for p in paths[i : i + 64] for r in read_file(p) if r["is_image"] or not self.images]
            if rows:
                yield _batch(rows)


class _FilteringReader(_Reader):
    """The reader that takes filters; Spark refuses one where spark.sql.python.filterPushdown.enabled is off."""

    def pushFilters(self, filters):
        """Image units only, and ranges, sets and prefixes of paths (compared by code points, as UTF-8 is); all others are left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("is_image",) and f.value is True:
                self.images = True
            elif type(f) in _ON_PATH and f.attribute == ("path",):
                self.tests.append((type(f), f.value))
            elif not (isinstance(f, IsNotNull) and f.attribute in (("path",), ("is_image",))):  # neither is ever null
                yield f


class HeaderSource(DataSource):
    """spark.dataSource.register(HeaderSource); spark.read.format("frame_headers").load(folder), or .option("listing", table).load()

    With .option("pushFilters", True), and spark.sql.python.filterPushdown.enabled on, filters on is_image and path reach the reader."""

    @classmethod
    def name(cls) -> str:
        return "frame_headers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _FilteringReader(self.options) if self.options.get("pushFilters", "false").lower() == "true" else _Reader(self.options)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """rel_path, path, size_bytes, mtime_utc of all files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = re.sub(r"^file:/+", "/", folder).rstrip("/") + "/"
    plain = F.regexp_replace("path", "^file:/+", "/")
    return files.select(F.substring(plain, len(base) + 1, 1 << 20).alias("rel_path"), "path", F.col("length").alias("size_bytes"), F.col("modificationTime").cast("timestamp_ntz").alias("mtime_utc"))


def card_map(headers: DataFrame) -> DataFrame:
    """Image units with `first`, a map of upper-case keywords to the value of their first card."""
    keys = F.transform("cards", lambda c: F.upper(c["keyword"]))
    distinct = F.array_distinct(keys)
    values = F.transform(distinct, lambda k: F.element_at(F.filter("cards", lambda c: F.upper(c["keyword"]) == k), 1)["value"])
    return headers.where("is_image").withColumn("first", F.map_from_arrays(distinct, values))
