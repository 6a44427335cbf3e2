"""Exact duplicates: equal texts meet in compressed radix tries, whose terminal nodes know the row that stays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, release

#: A task's trie holds so many bytes; beyond it, its heaviest subtree leaves for the next round.
TRIE_BYTES = 48 << 20
_NODE_BYTES = 240
#: A class of more owners of one length and hash is dealt to about its square root of tasks first.
FEW_OWNERS = 256
_BATCH_BYTES = 4 << 20
_ROW_BITS = 33


class Node:
    """An edge's bytes, the nodes after it by their first byte, and, where a text ends, its ``owner`` and row that stays."""

    __slots__ = ("label", "after", "owner", "n", "best", "row", "last")

    def __init__(self, label: bytes) -> None:
        self.label, self.after, self.owner = label, None, None

    def take(self, owner: int, n: int, best, row: int, last: bool) -> None:
        """Count ``n`` more rows; the largest id stays, of rows with that id the first row, a null id only without another."""
        if self.owner is None:
            self.owner, self.n, self.best, self.row, self.last = owner, n, best, row, last
            return
        self.n += n
        if (best is not None and (self.best is None or best > self.best)) or (best == self.best and row < self.row):
            self.best, self.row = best, row


class Trie:
    """Byte strings along compressed edges: a node is where strings part or where one ends.  ``count`` strings have an owner."""

    def __init__(self) -> None:
        self.root, self.size, self.count = Node(b""), 0, 0

    def place(self, key: bytes) -> Node:
        """The node at which ``key`` ends, made if it is not there."""
        node, at = self.root, 0
        while at < len(key):
            after = node.after.get(key[at]) if node.after else None
            if after is None:
                after = Node(key[at:])
                self._tie(node, after)
                self.size += _NODE_BYTES + len(after.label)
                return after
            if not key.startswith(after.label, at):
                after = self._part(node, after, key, at)
            node, at = after, at + len(after.label)
        return node

    @staticmethod
    def _tie(node: Node, after: Node) -> None:
        if node.after is None:
            node.after = {}
        node.after[after.label[0]] = after

    def _part(self, node: Node, after: Node, key: bytes, at: int) -> Node:
        """A new node where ``key`` leaves the edge of ``after``; the equal beginning is found by halving."""
        equal, differs = 1, min(len(after.label), len(key) - at + 1)
        while equal + 1 < differs:
            half = (equal + differs) // 2
            if key.startswith(after.label[:half], at):
                equal = half
            else:
                differs = half
        middle = Node(after.label[:equal])
        self._tie(node, middle)
        after.label = after.label[equal:]
        self._tie(middle, after)
        self.size += _NODE_BYTES
        return middle

    def texts(self, prefix: bytes = b"", top: Node | None = None) -> Iterator[tuple[bytes, Node]]:
        """Every text of a subtree with the node it ends in; ``prefix`` leads to the subtree, its edge included."""
        todo = [(prefix, top or self.root)]
        while todo:
            text, node = todo.pop()
            if node.owner is not None:
                yield text, node
            todo += [(text + x.label, x) for x in (node.after or {}).values()]

    def _weights(self) -> dict[int, int]:
        order = [self.root]
        for node in order:
            order += (node.after or {}).values()
        weight: dict[int, int] = {}
        for node in reversed(order):
            weight[id(node)] = _NODE_BYTES + len(node.label) + sum(weight[id(x)] for x in (node.after or {}).values())
        return weight

    def cut_heaviest(self) -> tuple[bytes, Node]:
        """Take the heaviest subtree out that is no more than half of the trie, or a single edge; returns its prefix and top."""
        weight = self._weights()
        node, prefix = self.root, b""
        while True:
            top = max(node.after.values(), key=lambda x: weight[id(x)])
            if not top.after or 2 * weight[id(top)] <= weight[id(self.root)]:
                del node.after[top.label[0]]
                self.size -= weight[id(top)]
                return prefix + top.label, top
            node, prefix = top, prefix + top.label


def _merged(rows: Iterator[tuple], limit: int) -> Iterator[tuple]:
    """Insert (owner, n, best, row, last, text), in place of each yield its node; then (text, node, whole) as texts leave.

    ``whole`` is false where equal texts may have left before: below a subtree that was taken out for want of memory,
    and where ``last`` says that other tasks hold equal texts.
    """
    trie, gone = Trie(), ()
    for owner, n, best, row, last, text in rows:
        node = trie.place(text)
        trie.count += node.owner is None
        node.take(owner, n, best, row, last)
        yield node.owner
        while trie.size > limit and trie.count > 1 and trie.root.after:  # a text alone stays, whatever its length
            prefix, top = trie.cut_heaviest()
            gone += (prefix,)
            for found, x in trie.texts(prefix, top):
                trie.count -= 1
                yield found, x, False
    for found, x in trie.texts():
        yield found, x, x.last and not (gone and found.startswith(gone))


class _Out:
    """Rows gathered to Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, size: int = 64) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size
        if self.size >= _BATCH_BYTES:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)], schema=self.schema)
            self.rows, self.size = [], 0


def _write_owners(docs: DataFrame, key: str, path: str, limit: int) -> None:
    """A row (owner, id, row) of each document, and of each owner its distinct text with number of rows, hash and digest.

    An owner is a text of one task's trie.  A task's equal texts become one before anything is shuffled, a text that
    half of the table repeats included.
    """
    kind = docs.select(key).schema[0].dataType
    schema = pa.schema([("owned", pa.bool_()), ("owner", pa.int64()), ("id", pa.null()), ("row", pa.int64()), ("n", pa.int64()), ("length", pa.int64()), ("hash", pa.int64()), ("digest", pa.string()), ("text", pa.binary())])

    def insert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << _ROW_BITS
        out = None
        ids: list = []

        def rows() -> Iterator[tuple]:
            nonlocal out
            number = base
            for batch in batches:
                if out is None:
                    out = _Out(schema.set(2, pa.field("id", batch.schema.field(0).type)))
                for key_value, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids.append(key_value)
                    yield number, 1, key_value, number, True, (text.as_py() or b"").lower()
                    number += 1

        row = base
        for found in _merged(rows(), limit):
            if isinstance(found, int):
                yield from out.add((True, found, ids.pop(), row, None, None, None, None, None))
                row += 1
            else:
                text, node, _ = found
                hashed = xxhash.xxh3_64_intdigest(text)
                hashed -= (hashed >> 63) << 64
                whole = (False, node.owner, node.best, node.row, node.n, len(text), hashed, hashlib.sha256(text).hexdigest(), text)
                yield from out.add(whole, 256 + len(text))
        if out is not None:
            yield from out.rest()
        release()

    schema_ddl = f"owned boolean, owner long, id {kind.simpleString()}, row long, n long, length long, hash long, digest string, text binary"
    docs.select(F.col(key).alias("id"), F.col("text").cast("binary").alias("text")).mapInArrow(insert, schema_ddl).write.parquet(path)


def _write_round(owners: DataFrame, path: str, limit: int) -> None:
    """Tries over owners dealt by length, hash and ``deal``: (owner, to) of every owner, and what each ``to`` has now."""
    id_type = owners.schema["id"].dataType.simpleString()
    schema = pa.schema([("owner", pa.int64()), ("to", pa.int64()), ("whole", pa.bool_()), ("id", pa.null()), ("row", pa.int64()), ("n", pa.int64()), ("length", pa.int64()), ("hash", pa.int64()), ("text", pa.binary())])

    def insert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, keys = None, [], {}

        def rows() -> Iterator[tuple]:
            nonlocal out
            for batch in batches:
                if out is None:
                    out = _Out(schema.set(3, pa.field("id", batch.schema.field("id").type)))
                plain = [batch.column(c).to_pylist() for c in ("owner", "n", "id", "row", "last")]
                for *values, text in zip(*plain, batch.column("text"), strict=True):
                    at.append(values[0])
                    yield *values, text.as_py()

        for found in _merged(rows(), limit):
            if isinstance(found, int):
                yield from out.add((at.pop(), found, None, None, None, None, None, None, None))
            else:
                text, node, whole = found
                hashed = xxhash.xxh3_64_intdigest(text)
                hashed -= (hashed >> 63) << 64
                left = (None, node.owner, whole, node.best, node.row, node.n, len(text), hashed, None if whole else text)
                yield from out.add(left, 256 + (0 if whole else len(text)))
        if out is not None:
            yield from out.rest()
        release()

    ddl = f"owner long, to long, whole boolean, id {id_type}, row long, n long, length long, hash long, text binary"
    owners.select("owner", "n", "id", "row", "last", "text").mapInArrow(insert, ddl).write.parquet(path)


def _dealt(owners: DataFrame, parts: int) -> DataFrame:
    """Owners of equal length and hash side by side; of classes with many, the square root of their number to a task."""
    sizes = owners.groupBy("length", "hash").agg(F.count(F.lit(1)).alias("owners"))
    tasks = F.when(F.col("owners") <= FEW_OWNERS, F.lit(1)).otherwise(F.ceil(F.sqrt("owners"))).cast("long")
    placed = owners.join(sizes.select("length", "hash", tasks.alias("tasks")), ["length", "hash"])
    placed = placed.withColumn("last", F.col("tasks") == 1).withColumn("deal", F.pmod(F.xxhash64("owner"), "tasks"))
    return placed.repartition(parts, "length", "hash", "deal")


def exact_groups(docs: DataFrame, key: str = "doc_id", limit: int = TRIE_BYTES) -> DataFrame:
    """(id, row, keep_id, keep_row, group_size, digest) of every row of ``docs``: its group of equal texts and who stays.

    Texts are equal if they are identical but for the case of A-Z; a null text is empty.  Of a group the row with the
    largest id stays, of several rows with that id the first of the table's files; a null id stays only where the
    group has no other.  Equality is decided byte by byte in tries; length and hash only say which texts have to meet.
    First each task's rows meet in a trie of their own.  Owners whose length and hash no other owner has are done; the
    texts of the others are dealt by length and hash to tries of the next round.  A class with owners from very many
    tasks is merged in two rounds, and a subtree that does not fit leaves for a round with twice the tasks.
    """
    spark = docs.sparkSession
    path = new_path(spark, "owners")
    _write_owners(docs, key, path, limit)
    written = spark.read.parquet(path)
    owners = written.where("not owned")
    classes = owners.groupBy("length", "hash").agg(F.count(F.lit(1)).alias("owners"))
    alone = classes.where("owners = 1").select("length", "hash")
    plain = ["owner", "id", "row", "n", "digest"]
    done = owners.join(alone, ["length", "hash"], "left_semi").select(*plain)
    several = owners.join(classes.where("owners > 1").select("length", "hash"), ["length", "hash"], "left_semi")
    todo = several.select("owner", "id", "row", "n", "length", "hash", "text")
    digests = several.select("owner", "digest")
    leads, ends, parts = None, None, int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        step = new_path(spark, "tries")
        _write_round(_dealt(todo, parts), step, limit)
        found = spark.read.parquet(step)
        moved = found.where("whole is null").select("owner", F.col("to").alias("next"))
        whole = found.where("whole").select(F.col("to").alias("next"), "id", "row", "n")
        leads = moved if leads is None else leads.withColumnRenamed("next", "at").join(moved.withColumnRenamed("owner", "at"), "at", "left").select("owner", F.coalesce("next", "at").alias("next"))
        ends = whole if ends is None else ends.unionByName(whole)
        todo = found.where("not whole").select(F.col("to").alias("owner"), "id", "row", "n", "length", "hash", "text")
        if todo.isEmpty():
            break
        parts *= 2
    of_many = leads.join(ends, "next").join(digests, "owner").select(*plain)
    groups = done.unionByName(of_many).select("owner", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("n").alias("group_size"), "digest")
    return written.where("owned").select("owner", "id", "row").join(groups, "owner").drop("owner")


def exact_duplicates(docs: DataFrame, key: str = "doc_id", limit: int = TRIE_BYTES) -> DataFrame:
    """(``key``, keep_id, group_size, kept, text_sha256) of every row of ``docs``, dropped ones too; see `exact_groups`."""
    found = exact_groups(docs, key, limit)
    return found.select(F.col("id").alias(key), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("digest").alias("text_sha256"))
