"""Export files cut into conversations by byte ranges, so that a file of any size is many tasks (SRC-1).

Spark's text reader deals a file out in byte ranges; cut at every ``{`` its rows are short and
each is read by exactly one range. What a range cannot know alone is where in the document it
begins. A first pass over the files of several ranges answers that: each range reports, for
both cases (it begins inside a string or not), how its brackets change the depth, and the
reports of a file, a few numbers per range, are added up in order. The second pass then cuts every
range for itself into

* conversations: the elements of the root list, or of the list ``conversations`` of a root object;
* the file's frame: all text around them, with ``{}`` in place of each conversation (runs of them
  as one). A root object that is itself the conversation is all frame;
* at a range's ends, the parts of a conversation that crosses them.

A document is well-formed if its frame and each of its conversations are, so they can be parsed
one by one with the one declared schema.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Kinds of the rows that ``cut_exports`` gives.
CONVERSATION, FRAME, HEAD, MIDDLE, TAIL = "conversation", "frame", "head", "middle", "tail"
#: Bytes of conversations handed on at once.
BATCH = 32 << 20

_BLANK = b" \t\r\n"
_KEY = re.compile(rb'(?:^|[^\\])"conversations"[ \t\r\n]*:[ \t\r\n]*\Z')
_DELTA = np.zeros(256, dtype=np.int8)
_DELTA[[ord("{"), ord("[")]] = 1
_DELTA[[ord("}"), ord("]")]] = -1


def brackets(data: bytes, in_string: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """(place, +1 or -1) of the brackets outside strings, and whether the end is inside one. ``data`` does not
    begin behind a backslash."""
    a = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(a == 34)
    behind = np.zeros(len(quotes), np.int64)  # backslashes right before the quote
    live = np.arange(len(quotes))
    while len(live):
        at = quotes[live] - 1 - behind[live]
        live = live[(at >= 0) & (a[at] == 92)]
        behind[live] += 1
    quotes = quotes[behind % 2 == 0]
    at = np.flatnonzero(_DELTA[a])
    outside = (np.searchsorted(quotes, at) + in_string) % 2 == 0
    at = at[outside]
    return at, _DELTA[a[at]].astype(np.int64), bool((len(quotes) + in_string) % 2)


def root_of(data: bytes) -> str | None:
    """The first character of the document, behind a byte-order mark and white space."""
    rest = data.removeprefix(b"\xef\xbb\xbf").lstrip(_BLANK)
    return chr(rest[0]) if rest else None


def opens_list(data: bytes, at: int) -> bool:
    """The bracket stands behind the key ``conversations``."""
    return data[at:at + 1] == b"[" and _KEY.search(data, max(0, at - 4096), at) is not None


@dataclass
class Start:
    """Where a range begins: inside a string, how deep, inside the list of conversations, the root's character."""

    in_string: bool = False
    depth: int = 0
    in_list: bool = False
    root: str | None = None


@dataclass
class _Case:
    """A range's report for one case of its begin; depths are relative to it."""

    in_string: bool
    depth: int = 0
    low: int = 0
    lists: list[list[int]] = field(default_factory=list)  # (depth before, lowest depth since) of each list of conversations

    def add(self, data: bytes) -> None:
        at, delta, self.in_string = brackets(data, self.in_string)
        if not len(at):
            return
        after = self.depth + np.cumsum(delta)
        for x in self.lists:
            x[1] = min(x[1], int(after.min()))
        self.low = min(self.low, int(after.min()))
        found = data.find(b'"conversations"')
        while found >= 0:
            k = int(np.searchsorted(at, found))
            if k < len(at) and opens_list(data, int(at[k])):
                self.lists.append([int(after[k] - delta[k]), int(after[k:].min())])
            found = data.find(b'"conversations"', found + 1)
        self.depth = int(after[-1])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bytes, bool, bool]]:
    """(range, its next bytes, whether these are its first, whether a later call has more of any) in order."""
    now = None
    for batch in batches:
        paths, starts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        values = batch.column(5)
        s = 0
        while s < len(paths):
            e = s + 1
            while e < len(paths) and starts[e] == starts[s] and paths[e] == paths[s]:
                e += 1
            first = now != (paths[s], starts[s])
            now = (paths[s], starts[s])
            data = b"{".join(values.slice(s, e - s).to_pylist())
            if not (first and starts[s] == 0):
                data = b"{" + data  # every row but a file's first stands behind one
            row = {"path": paths[s], "file": batch.column(1)[s].as_py(), "start": starts[s],
                   "whole": starts[s] == 0 and batch.column(3)[s].as_py() >= batch.column(4)[s].as_py()}
            yield row, data, first
            s = e


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, cases, root = None, [], None

    def done() -> pa.RecordBatch:
        text = json.dumps([root, [[c.in_string, c.depth, c.low, c.lists] for c in cases]])
        return pa.RecordBatch.from_arrays([pa.array([last["path"]]), pa.array([last["start"]], pa.int64()), pa.array([text])], names=["path", "start", "report"])

    for row, data, first in _runs(batches):
        if first:
            if last:
                yield done()
            last, cases, root = row, [_Case(False), _Case(True)], None
        if root is None and row["start"] == 0:
            root = root_of(data)
        for c in cases:
            c.add(data)
    if last:
        yield done()


def range_starts(pieces: DataFrame) -> dict[str, dict[int, Start]]:
    """Of the files of more than one range: where each range but the first begins. The driver holds a few
    numbers per range (128 MB as a rule: under a million ranges for 100 TB)."""
    rows = pieces.where("length < size").mapInArrow(_reports, "path string, start long, report string").orderBy("path", "start").collect()
    out: dict[str, dict[int, Start]] = {}
    now = Start()
    for r in rows:
        root, cases = json.loads(r["report"])
        if r["path"] not in out:
            out[r["path"]], now = {}, Start(root=root)
        else:
            out[r["path"]][r["start"]] = Start(now.in_string, now.depth, now.in_list, now.root)
        in_string, depth, low, lists = cases[now.in_string]
        in_list = now.in_list and now.depth + low > 1
        for before, lowest in lists:
            if now.root == "{" and now.depth + before == 1:
                in_list = now.depth + lowest > 1
        now = Start(in_string, now.depth + depth, in_list, now.root)
    return out


class Cutter:
    """Cuts one range; ``feed`` takes its bytes in order."""

    def __init__(self, start: Start) -> None:
        self.at = Start(start.in_string, start.depth, start.in_list, start.root)
        self.frame: list[bytes] = []
        self.ready: list[bytes] = []
        self.tail: bytes | None = None
        self.open: list[bytes] | None = [] if self._inside() else None
        self.continued = self.open is not None
        self.joined = False

    def _base(self) -> int:
        return 1 if self.at.root == "[" else 2

    def _inside(self) -> bool:
        return self.at.depth > self._base() and (self.at.root == "[" or self.at.in_list)

    def feed(self, data: bytes) -> None:
        s = self.at
        if s.root is None:
            s.root = root_of(data)
        base, done = self._base(), 0
        places, delta, s.in_string = brackets(data, s.in_string)
        after = s.depth + np.cumsum(delta)
        low = np.flatnonzero(np.minimum(after, after - delta) <= base)
        for p, d, depth in zip(places[low].tolist(), delta[low].tolist(), after[low].tolist(), strict=True):
            if self.open is not None:
                if d < 0 and depth == base:
                    self._close(data[done:p + 1])
                    done = p + 1
            elif d > 0 and depth == base + 1 and (s.root == "[" or s.in_list):
                between = data[done:p]
                self.joined = between.strip(_BLANK) == b"," and self.frame[-1:] == [b"{}"] and data[p:p + 1] == b"{"
                if not self.joined:
                    self.frame.append(between)
                self.open, done = [], p
            elif s.root == "{" and d > 0 and depth == 2:
                s.in_list = opens_list(data, p)
            elif s.root == "{" and depth == 1:
                s.in_list = False
        (self.frame if self.open is None else self.open).append(data[done:])
        s.depth = int(after[-1]) if len(after) else s.depth

    def _close(self, last: bytes) -> None:
        text = b"".join([*self.open, last])
        if self.continued:
            self.tail, self.continued = text, False
            # the range of its head has put the placeholder
        elif text[:1] == b"{":
            self.ready.append(text)
            if not self.joined:
                self.frame.append(b"{}")
        else:
            self.frame.append(b"[]")  # no conversation; the parser says so
        self.open = None

    def rest(self) -> list[tuple[str, bytes]]:
        """What is left at the range's end."""
        out = [] if self.tail is None else [(TAIL, self.tail)]
        if self.open is not None:
            text = b"".join(self.open)
            out.append((MIDDLE if self.continued else HEAD, text))
            if not self.continued and not self.joined:
                self.frame.append(b"{}" if text[:1] == b"{" else b"[]")
        return [*out, (FRAME, b"".join(self.frame))]


def cut_exports(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, file, start, whole, kind, json): files as conversations, frames and parts of either (see above).
    whole: the range is the whole file. Spark does not list empty files; they give nothing."""
    pieces = spark.read.option("lineSep", "{").text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_block_length").alias("length"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))
    listed = spark.read.format("binaryFile").load(paths).select("path", "length")  # the files' names and sizes alone
    least = min(_bytes(spark, "spark.sql.files.maxPartitionBytes"), _bytes(spark, "spark.sql.files.openCostInBytes"))
    starts = {} if listed.where(F.col("length") > least).isEmpty() else range_starts(pieces)
    held = spark.sparkContext.broadcast(starts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, cutter = None, None

        def rows(found: list[tuple[str, bytes]]) -> pa.RecordBatch:
            n = len(found)
            return pa.RecordBatch.from_arrays(
                [pa.array([row[k]] * n, t) for k, t in (("path", pa.string()), ("file", pa.string()), ("start", pa.int64()), ("whole", pa.bool_()))]
                + [pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.binary())], names=["path", "file", "start", "whole", "kind", "json"])

        def ready() -> Iterator[pa.RecordBatch]:
            held_, cutter.ready = cutter.ready, []
            s, size = 0, 0
            for e, text in enumerate(held_):
                if e > s and size + len(text) > BATCH:
                    yield rows([(CONVERSATION, x) for x in held_[s:e]])
                    s, size = e, 0
                size += len(text)
            if held_[s:]:
                yield rows([(CONVERSATION, x) for x in held_[s:]])

        for now, data, first in _runs(batches):
            if first:
                if cutter:
                    yield from ([rows([x]) for x in cutter.rest()])
                row, cutter = now, Cutter(held.value.get(now["path"], {}).get(now["start"], Start()))
            cutter.feed(data)
            yield from ready()
        if cutter:
            yield from ([rows([x]) for x in cutter.rest()])

    return pieces.mapInArrow(cut, "path string, file string, start long, whole boolean, kind string, json binary")


def _bytes(spark: SparkSession, key: str) -> int:
    return int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)))


def joined_parts(parts: DataFrame) -> DataFrame:
    """(path, file, kind, json) of conversations and frames that several ranges hold, put together from
    ``parts``, the rows of ``cut_exports`` that are neither conversations nor whole."""
    crossing = parts.where(F.col("kind").isin(HEAD, MIDDLE, TAIL))
    order = Window.partitionBy("path").orderBy("start", F.col("kind") == HEAD)
    # without the texts: a conversation is numbered by the heads up to it
    numbered = crossing.select("path", "start", "kind").withColumn("number", F.sum((F.col("kind") == HEAD).cast("long")).over(order))
    crossing = crossing.join(numbered, ["path", "start", "kind"])
    frames = parts.where(F.col("kind") == FRAME).withColumn("number", F.lit(-1).cast("long"))
    pieces = crossing.select("path", "file", "number", "start", "kind", "json").unionByName(frames.select("path", "file", "number", "start", "kind", "json"))
    held = pieces.groupBy("path", "file", "number").agg(F.sort_array(F.collect_list(F.struct("start", (F.col("kind") == HEAD).alias("head"), "json"))).alias("p"))
    text = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["json"]))
    return held.select("path", "file", F.when(F.col("number") < 0, F.lit(FRAME)).otherwise(F.lit(CONVERSATION)).alias("kind"), text.alias("json"))
