"""Merkle manifest of a dataset: digests, proofs and their verification.

Every row is a leaf; the leaves of a group (`source`) make a tree, the roots of the trees,
in the order of the groups, one more. The nodes of a part of the leaves that still lack
a sibling form a forest, keyed by tree, level and index. Two forests of disjoint parts
merge by union: a run of siblings of known size that becomes whole gives way to its
parent, and so on upward. Merging is associative and commutative. A part that is a range
of the order leaves a few nodes a level, however many rows it has, so forests are merged
up a tree of tasks; the nodes made on the way are kept, as proofs need them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.llm._common import checkpoint, require, working

ARITY = 3
#: The tree of the groups' roots; the others are numbered from 0 in the order of the groups.
TOP = -1
#: Rows of a part at most, about: a task holds one part's digests.
PART_ROWS = 200_000
#: Forests that one task merges.
FAN_IN = 32


def encoded(value: Column) -> Column:
    """`-` for null, else the UTF-8 length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]).cast("binary"), 256)


def digest(parts: Iterable[bytes]) -> bytes:
    """Lower-case hex of sha256 over hex digests, one after the other."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def width(n: int, level: int, arity: int = ARITY) -> int:
    """Nodes of a level above n leaves."""
    for _ in range(level):
        n = -(-n // arity)
    return n


class Forest:
    """Unresolved nodes keyed by tree, level and index.

    `sizes` tells the leaves of the trees where known; in other trees only full runs
    resolve. `made` is called with every parent that a merge makes.
    """

    def __init__(self, sizes: dict[int, int], arity: int = ARITY, made: Callable[[int, int, int, bytes], None] | None = None) -> None:
        self.sizes, self.arity, self.made = dict(sizes), arity, made
        self.nodes: dict[int, dict[tuple[int, int], bytes]] = {}

    def add(self, tree: int, level: int, index: int, node: bytes) -> None:
        while True:
            n = self.sizes.get(tree)
            wide = None if n is None else width(n, level, self.arity)
            if wide == 1 and tree != TOP:
                tree, level, index = TOP, 0, tree
                if self.made:
                    self.made(tree, level, index, node)
                continue
            held = self.nodes.setdefault(tree, {})
            held[level, index] = node
            if wide == 1:
                return
            first = index - index % self.arity
            places = [(level, first + j) for j in range(self.arity if wide is None else min(self.arity, wide - first))]
            if any(p not in held for p in places):
                return
            node = digest(held.pop(p) for p in places)
            level, index = level + 1, index // self.arity
            if self.made:
                self.made(tree, level, index, node)

    def close(self, tree: int, n: int) -> None:
        """The tree turns out to have n leaves."""
        self.sizes[tree] = n
        for (level, index), node in sorted(self.nodes.pop(tree, {}).items()):
            self.add(tree, level, index, node)

    def merge(self, other: Forest) -> Forest:
        for tree, n in other.sizes.items():
            if self.sizes.setdefault(tree, n) != n:
                raise ValueError("forests disagree on the size of a tree")
        for tree in list(self.nodes):
            if tree in other.sizes:
                self.close(tree, other.sizes[tree])
        for tree, held in other.nodes.items():
            for (level, index), node in held.items():
                self.add(tree, level, index, node)
        return self

    def items(self) -> Iterator[tuple[int, int, int, bytes]]:
        for tree, held in self.nodes.items():
            for (level, index), node in held.items():
                if held:
                    yield tree, level, index, node


def wanted(n: int, a: int, b: int, inside: tuple[int, int], arity: int = ARITY) -> Iterator[tuple[int, int]]:
    """Level and index of what proofs of the leaves a to b - 1 need and cannot make from the leaves `inside`."""
    level, size, wide = 0, 1, n
    while wide > 1:
        low, high = a // size // arity * arity, min((b - 1) // size // arity * arity + arity, wide)
        first, last = -(-inside[0] // size), wide if inside[1] == n else inside[1] // size
        if first >= last:
            first = last = high
        yield from ((level, i) for i in range(low, min(first, high)))
        yield from ((level, i) for i in range(max(last, low), high))
        level, size, wide = level + 1, size * arity, -(-wide // arity)
    if not (inside[0] == 0 and inside[1] == n):
        yield level, 0


class Levels:
    """All nodes of a tree that a range of its leaves makes, and what else is known of the tree."""

    def __init__(self, n: int, start: int, leaves: list[bytes], known: dict[tuple[int, int], bytes], arity: int = ARITY) -> None:
        self.arity, self.known, self.widths, self.rows = arity, known, [n], [(start, leaves)]
        while self.widths[-1] > 1:
            wide, (first, nodes) = self.widths[-1], self.rows[-1]
            end, at = first + len(nodes), -(-first // arity)
            up = []
            while at * arity < end and min(at * arity + arity, wide) <= end:
                up.append(digest(nodes[at * arity - first : min(at * arity + arity, wide) - first]))
                at += 1
            self.rows.append((at - len(up), up))
            self.widths.append(-(-wide // arity))

    def node(self, level: int, index: int) -> bytes:
        first, nodes = self.rows[level]
        return nodes[index - first] if first <= index < first + len(nodes) else self.known[level, index]

    def siblings(self, level: int, index: int) -> tuple[list[bytes], int]:
        """The others of the node's run, and how many of them come before it."""
        first = index - index % self.arity
        run = range(first, min(first + self.arity, self.widths[level]))
        return [self.node(level, i) for i in run if i != index], index - first


class Paths:
    """Proofs and folds up one tree and then up the next; neighbours share what they have in common."""

    def __init__(self, levels: Levels, above: Paths | None, place: int) -> None:
        self.levels, self.above, self.place = levels, above, place
        self._proof: dict[int, tuple[int, list[bytes]]] = {}
        self._fold: dict[int, tuple[int, bytes, bytes]] = {}

    def proof(self, level: int, index: int) -> list[bytes]:
        if self.levels.widths[level] == 1:
            return self.above.proof(0, self.place) if self.above else []
        last = self._proof.get(level)
        if last is None or last[0] != index:
            last = self._proof[level] = index, self.levels.siblings(level, index)[0] + self.proof(level + 1, index // self.levels.arity)
        return last[1]

    def fold(self, level: int, index: int, node: bytes) -> bytes:
        """The root that follows from this node and the siblings on its way."""
        if self.levels.widths[level] == 1:
            return self.above.fold(0, self.place, node) if self.above else node
        last = self._fold.get(level)
        if last is None or last[:2] != (index, node):
            others, before = self.levels.siblings(level, index)
            last = self._fold[level] = index, node, self.fold(level + 1, index // self.levels.arity, digest([*others[:before], node, *others[before:]]))
        return last[2]


class _Spans:
    """Where every part lies: tree and place of its first row, and the sizes of the trees of its first and last row."""

    def __init__(self, parts: list) -> None:
        self.of: dict[int, tuple[int, int]] = {}
        self.sizes: dict[int, int] = {}
        tree, running, before = -1, 0, None
        for r in parts:
            same = before is not None and r["first"] == before
            tree, base = (tree, running) if same else (tree + 1, 0)
            self.of[r["part"]] = tree, base
            self.sizes[tree] = base + r["n_first"]
            running = base + r["n_first"]
            if r["groups"] > 1:
                tree, running = tree + r["groups"] - 1, r["n_last"]
                self.sizes[tree] = running
            before = r["last"]
        self.trees = tree + 1


_NODE = "part int, tree long, leaves long, level int, idx long, digest binary, made boolean, open boolean"


def _segments(rows: Iterator[tuple], tree: int, base: int) -> Iterator[tuple[int, int, list]]:
    """Tree, first place and rows of each group, from rows in order whose first value is the group."""
    held, now = [], None
    for r in rows:
        if held and r[0] != now:
            yield tree, base, held
            tree, base, held = tree + 1, 0, []
        now = r[0]
        held.append(r)
    if held:
        yield tree, base, held


def _climb(spans: _Spans, arity: int):
    """Up: every part's forest, and what its proofs will want."""
    sizes, where, trees = spans.sizes, spans.of, spans.trees

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with working("merkle"):
            forest = part = tree = None
            index = start = first_tree = 0
            ranges: list[tuple[int, int, int]] = []
            group: object = None
            for batch in batches:
                for p, g, leaf in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if forest is None:
                        part, group, (tree, index) = p, g, where[p]
                        first_tree, start = tree, index
                        forest = Forest({TOP: trees} | ({tree: sizes[tree]} if tree in sizes else {}), arity)
                    elif g != group:
                        ranges.append((tree, start, index))
                        if tree not in forest.sizes:
                            forest.close(tree, index)
                        group, tree, index, start = g, tree + 1, 0, 0
                        if tree in sizes:
                            forest.sizes[tree] = sizes[tree]
                    forest.add(tree, 0, index, leaf.hex().encode())
                    index += 1
            if forest is None:
                return
            ranges.append((tree, start, index))
            rows = [(part, t, forest.sizes[t], level, i, bytes.fromhex(node.decode()), True, True) for t, level, i, node in forest.items()]
            whole = [t for t, a, b in ranges if a == 0 and b == forest.sizes[t]]
            for t, a, b in (ranges[0], ranges[-1]) if len(ranges) > 1 else ranges:
                if t not in whole:
                    n = forest.sizes[t]
                    rows += [(part, t, n, level, i, None, False, False) for level, i in wanted(n, a, b, (a, b), arity) if width(n, level, arity) > 1]
            inside = (whole[0], whole[-1] + 1) if whole else (first_tree, first_tree)
            rows += [(part, TOP, trees, level, i, None, False, False) for level, i in wanted(trees, first_tree, tree + 1, inside, arity)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _ARROW, strict=True)], names=_NAMES)

    return climb


_NAMES = ["part", "tree", "leaves", "level", "idx", "digest", "made", "open"]
_ARROW = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_()]


def _merge(trees: int, arity: int):
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        fresh: dict[tuple[int, int, int], bytes] = {}
        forest = Forest(dict(zip(rows["tree"], rows["leaves"], strict=True)) | {TOP: trees}, arity, lambda t, level, i, node: fresh.__setitem__((t, level, i), node))
        for _, part in rows.groupby("part", sort=True):
            other = Forest(dict(zip(part["tree"], part["leaves"], strict=True)), arity)
            for t, level, i, node in zip(part["tree"], part["level"], part["idx"], part["digest"], strict=True):
                other.nodes.setdefault(t, {})[level, i] = bytes(node).hex().encode()
            forest.merge(other)
        left = {(t, level, i): node for t, level, i, node in forest.items()}
        every = left | fresh
        out = [(int(rows["part"].min()), t, forest.sizes[t], level, i, bytes.fromhex(node.decode()), (t, level, i) in fresh, (t, level, i) in left) for (t, level, i), node in every.items()]
        return pd.DataFrame(out, columns=_NAMES)

    return merge


def _descend(spans: _Spans, arity: int, schema: pa.Schema, with_proof: bool):
    """Down: proofs and folds of every part, which comes after the nodes it wants."""
    sizes, where, trees = spans.sizes, spans.of, spans.trees

    def rows_of(part: int, known: dict[int, dict], ids: list[pa.Array], rows: list[tuple]) -> pa.RecordBatch:
        tree, base = where[part]
        segments = [(t, a, sizes.get(t, a + len(held)), held) for t, a, held in _segments(iter(rows), tree, base)]
        trees_of = [Levels(n, a, [r[1] for r in held], known.get(t, {}), arity) for t, a, n, held in segments]
        roots = [(t, made.rows[-1][1][0]) for (t, a, n, held), made in zip(segments, trees_of, strict=True) if a == 0 and len(held) == n]
        top = Levels(trees, roots[0][0] if roots else tree, [node for _, node in roots], known.get(TOP, {}), arity)
        above = Paths(top, None, 0)
        root = top.node(len(top.widths) - 1, 0)
        out: list[tuple] = []
        for (t, a, _, held), made in zip(segments, trees_of, strict=True):
            paths, subroot = Paths(made, above, t), top.node(0, t).decode()
            for i, (_, leaf, other) in enumerate(held, a):
                proof, folded = paths.proof(0, i), paths.fold(0, i, other or leaf)
                out.append((leaf.decode(), subroot, root.decode(), digest(proof).decode(), folded.decode(), folded == root, i, [p.decode() for p in proof] if with_proof else None))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *[pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(schema)[1:], strict=True)]], schema=schema)

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with working("merkle"):
            part, known, ids, rows = None, {}, [], []
            for batch in batches:
                column = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
                leaf_at = pa.compute.is_null(column["level"])
                for p in pa.compute.unique(column["part"]).to_pylist():
                    mine = pa.compute.equal(column["part"], p)
                    if p != part:
                        if rows:
                            yield rows_of(part, known, ids, rows)
                        part, known, ids, rows = p, {}, [], []
                    spine = batch.filter(pa.compute.and_(mine, pa.compute.invert(leaf_at)))
                    for t, level, i, node in zip(*[spine.column(spine.schema.get_field_index(c)).to_pylist() for c in ("tree", "level", "idx", "digest")], strict=True):
                        known.setdefault(t, {})[level, i] = node.hex().encode()
                    leaves = batch.filter(pa.compute.and_(mine, leaf_at))
                    ids.append(leaves.column(leaves.schema.get_field_index("id")))
                    for g, leaf, other in zip(*[leaves.column(leaves.schema.get_field_index(c)).to_pylist() for c in ("grp", "digest", "other")], strict=True):
                        rows.append((g, leaf.hex().encode(), other.hex().encode() if other is not None else None))
            if rows:
                yield rows_of(part, known, ids, rows)

    return descend


def merkle_manifest(docs: DataFrame, columns: list[str], tampered: dict[str, Column] | None = None, key: str = "doc_id", group: str = "source", arity: int = ARITY, with_proof: bool = False, part_rows: int = PART_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """Per row: `key`, leaf, subroot, root, proof_sha256, folded_root, verified, place (in its group) and proof.

    A leaf is the digest of `columns`; leaves of a group ascend by `key`, nulls first.
    `tampered` gives replacements of columns; the root is then recomputed from the leaf
    they make and the original siblings. `proof` lists the siblings from the leaf to the
    root and is null unless `with_proof`. Null values have an encoding of their own, an
    empty text is `0:`; texts of any length are hashed by the JVM in their row. Rows that
    repeat a key follow the order of their leaves; equal rows are leaves of their own, in
    any order (their digests are equal). A null group is a group, the first. An empty
    table gives no rows. Other columns are left out, whatever their names.
    """
    require(docs, key, group, *columns)
    spark, id_type = docs.sparkSession, docs.schema[key].dataType
    value = {c: F.col(f"`{c}`") for c in columns}
    leaf = leaf_digest(list(value.values()))
    other = leaf_digest([(tampered or {}).get(c, v) for c, v in value.items()])
    named = docs.select(F.col(group).cast("string").alias("grp"), F.col(key).alias("id"), F.unhex(leaf).alias("digest"), F.unhex(other).alias("other"))
    leaves = checkpoint(named.withColumn("other", F.when(F.col("other") != F.col("digest"), F.col("other"))).withColumn("nr", F.monotonically_increasing_id()))
    schema = T.StructType([T.StructField(key, id_type), *[T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], T.StructField("verified", T.BooleanType()), T.StructField("place", T.LongType()), T.StructField("proof", T.ArrayType(T.StringType()))])
    count = leaves.count()
    if not count:
        return spark.createDataFrame([], schema)
    order = [F.asc_nulls_first("grp"), F.asc_nulls_first("id"), F.asc("digest"), F.asc("nr")]
    pieces = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // part_rows))
    ordered = leaves.repartitionByRange(pieces, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()).drop("nr")
    ordered = checkpoint(ordered)

    # one row a part reaches the driver: which groups it begins and ends with, how often, and how many it has
    each = ordered.groupBy("part", "grp").agg(F.count("*").alias("n"), F.min("row").alias("at"))
    edge = F.struct("at", F.sha2(F.coalesce("grp", F.lit("")).cast("binary"), 256).alias("g"), F.col("grp").isNull().alias("null"), "n")
    parts = each.groupBy("part").agg(F.count("*").alias("groups"), F.min(edge).alias("low"), F.max(edge).alias("high"))
    name = lambda e: F.concat(F.col(f"{e}.g"), F.col(f"{e}.null").cast("string"))
    spans = _Spans(parts.select("part", "groups", name("low").alias("first"), name("high").alias("last"), F.col("low.n").alias("n_first"), F.col("high.n").alias("n_last")).orderBy("part").collect())

    forests = checkpoint(ordered.select("part", "grp", "digest").mapInArrow(_climb(spans, arity), _NODE))
    made = forests.where("open")
    now, span = made, 1
    while span <= max(spans.of):
        span *= fan_in
        merged = checkpoint(now.groupBy(F.floor(F.col("part") / span)).applyInPandas(_merge(spans.trees, arity), _NODE))
        made, now = made.union(merged.where("made")), merged.where("open")
    wants = forests.where("not open").select("part", "tree", "level", "idx")
    spine = wants.join(made.select("tree", "level", "idx", "digest"), ["tree", "level", "idx"])

    both = spine.select("part", F.lit(-1).cast("long").alias("row"), "tree", "level", "idx", "digest").unionByName(ordered, allowMissingColumns=True)
    both = both.select("part", "row", "tree", "level", "idx", "digest", "grp", "id", "other").repartition(pieces, "part").sortWithinPartitions("part", "row")
    return both.mapInArrow(_descend(spans, arity, _arrow_schema(schema), with_proof), schema)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def tampered_text(text: str = "text", key: str = "doc_id") -> dict[str, Column]:
    """Line feeds taken out of the texts whose key has an even crc32."""
    even = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 2 == 0
    return {text: F.when(even, F.regexp_replace(F.col(text), "\n", "")).otherwise(F.col(text))}
