"""Operator 11: a Merkle manifest of a dataset, built by event-driven combining of partial parents.

Leaves are ranked in their tree by a range partitioning, so one tree may hold most rows and still lie over many tasks.
A tree's size gives the arity of each of its parents. A task takes children as events: each goes to its partial parent,
and the parent whose arity is met emits its own digest as the next event, up the tree. What a task can't complete, a few
parents for each level and edge of its range, is the frontier: combineByKey brings the parts of a parent together, and
completed ones emit ancestors again, until no frontier is left. Every completed parent keeps links to its children;
from the roots down these give each leaf its proof. Each round is written to the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shared, ranked

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Kinds of rows that a round gives.
LINK, OPEN, ROOT = 0, 1, 2


def leaf_digest(values: list[Column]) -> Column:
    """sha256 of the values one after another, each `-` if null, else its UTF-8 byte count, a colon and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def nodes_at(total: int, level: int, arity: int = ARITY) -> int:
    """Nodes of a level in a tree of so many leaves."""
    for _ in range(level):
        total = -(-total // arity)
    return total


def cascade(events: Iterable[tuple], partial: dict[tuple, tuple], arity: int) -> Iterator[tuple]:
    """Takes nodes (tree, total, level, place, digest, doc, changed); gives the links and roots that they complete.

    partial holds what each parent (tree, level, place) has so far: (total, children by place); what stays there is open.
    """
    for event in events:
        todo = [event]
        while todo:
            tree, total, level, place, *child = todo.pop()
            width = nodes_at(total, level, arity)
            if width == 1:
                yield (ROOT, tree, total, level, place, [(place, *child)])
                continue
            key = (tree, level + 1, place // arity)
            children = partial.setdefault(key, (total, {}))[1]
            children[place] = child
            if len(children) == min(arity, width - key[2] * arity):
                row, todo = _completed(key, *partial.pop(key))
                yield row


def _completed(key: tuple, total: int, children: dict[int, list]) -> tuple[tuple, list[tuple]]:
    """The link of a parent whose arity is met, and the event that it is in turn."""
    run = [(place, *children[place]) for place in sorted(children)]
    digest = hashlib.sha256("".join(c[1] for c in run).encode()).hexdigest()
    return (LINK, key[0], total, key[1], key[2], run), [(key[0], total, key[1], key[2], digest, None, None)]


def _opened(partial: dict[tuple, tuple]) -> Iterator[tuple]:
    for (tree, level, place), (total, children) in partial.items():
        yield (OPEN, tree, total, level, place, [(at, *child) for at, child in children.items()])


def _schema(doc: T.DataType) -> T.StructType:
    child = T.StructType().add("place", "long").add("digest", "string").add("doc", doc).add("changed", "string")
    return T.StructType().add("kind", "integer").add("tree", "string").add("total", "long").add("level", "integer").add("place", "long").add("children", T.ArrayType(child))


def _first_round(arity: int) -> object:
    """Leaves to links, roots and the open parents of one task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partial: dict[tuple, tuple] = {}

        def made(rows: list[tuple], doc: pa.DataType) -> pa.RecordBatch:
            child = pa.struct([("place", pa.int64()), ("digest", pa.string()), ("doc", doc), ("changed", pa.string())])
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.list_(child))
            runs = [[dict(zip(("place", "digest", "doc", "changed"), c, strict=True)) for c in r[5]] for r in rows]
            columns = [*zip(*[r[:5] for r in rows], strict=True), runs] if rows else [[] for _ in kinds]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["kind", "tree", "total", "level", "place", "children"])

        doc = None
        for batch in batches:
            doc = batch.schema.field("doc").type
            trees, totals, places, digests, docs, changed = (batch.column(c).to_pylist() for c in ("tree", "total", "place", "digest", "doc", "changed"))
            yield made(list(cascade(((t, n, 0, p, d, i, c) for t, n, p, d, i, c in zip(trees, totals, places, digests, docs, changed, strict=True)), partial, arity)), doc)
        if doc is not None:
            yield made(list(_opened(partial)), doc)

    return run


def _next_round(arity: int) -> object:
    """Combined parents to links, roots and what is still open."""

    def run(parents: Iterable[tuple]) -> Iterator[tuple]:
        partial: dict[tuple, tuple] = {}
        for key, (total, children) in parents:
            if key in partial:  # an ancestor that a parent of this task has reached already
                children = partial.pop(key)[1] | children
            if len(children) < min(arity, nodes_at(total, key[1] - 1, arity) - key[2] * arity):
                partial[key] = (total, children)
                continue
            row, events = _completed(key, total, children)
            yield row
            yield from cascade(events, partial, arity)
        yield from _opened(partial)

    return run


@dataclass
class Forest:
    """Trees that are built: a link (tree, total, level, place, children) for each parent, and a root for each tree."""

    links: DataFrame
    roots: DataFrame
    height: int


def build(leaves: DataFrame, shared: Shared, name: str, arity: int = ARITY) -> Forest:
    """Trees over leaves (tree, place, total, digest, doc, changed): places run from 0 to total - 1 in each tree.

    A round whose rows are lost is made again from the one before it, which is in the shared folder.
    """
    spark, schema = leaves.sparkSession, _schema(leaves.schema["doc"].dataType)
    made = shared.keep(leaves.select("tree", "total", "place", "digest", "doc", "changed").mapInArrow(_first_round(arity), schema), f"{name}-0")
    rounds = [made]
    while not (frontier := made.where(F.col("kind") == OPEN)).isEmpty():
        keyed = frontier.rdd.map(lambda r: ((r.tree, r.level, r.place), (r.total, {c[0]: list(c[1:]) for c in r.children})))
        parents = keyed.combineByKey(lambda x: x, lambda a, b: (a[0], a[1] | b[1]), lambda a, b: (a[0], a[1] | b[1]), int(spark.conf.get("spark.sql.shuffle.partitions")))
        made = shared.keep(spark.createDataFrame(parents.mapPartitions(_next_round(arity)), schema), f"{name}-{len(rounds)}")
        rounds.append(made)
    whole = rounds[0]
    for one in rounds[1:]:
        whole = whole.unionByName(one)
    most = whole.where(F.col("kind") == ROOT).agg(F.max("level")).first()[0]
    return Forest(whole.where(F.col("kind") == LINK).drop("kind"), whole.where(F.col("kind") == ROOT).drop("kind"), most or 0)


PATH = "array<struct<before:string,after:string>>"


def proofs(forest: Forest, tops: DataFrame) -> DataFrame:
    """From the roots down: rows (tree, leaf, doc, changed, subroot, path) of all leaves.

    tops (tree, subroot, up) tells how each root goes on. A path has the siblings before and after a node for each level,
    from the leaf up.
    """
    roots = forest.roots.join(tops, "tree").select("tree", "level", "place", "children", "subroot", "up").withColumn("up", F.col("up").cast(PATH))
    leaf = lambda child: (F.col(f"{child}.digest").alias("leaf"), F.col(f"{child}.doc").alias("doc"), F.col(f"{child}.changed").alias("changed"))
    done = roots.where("level = 0").select("tree", F.explode("children").alias("child"), "subroot", "up").select("tree", *leaf("child"), "subroot", F.col("up").alias("path"))
    above = None
    for level in range(forest.height, 0, -1):
        known = roots.where(F.col("level") == level).select("tree", "place", "subroot", "up")
        known = known if above is None else known.unionByName(above)
        run = forest.links.where(F.col("level") == level).select("tree", "place", "children").join(known, ["tree", "place"])
        digests = F.col("children.digest")
        step = F.struct(F.array_join(F.slice(digests, F.lit(1), F.col("at")), "").alias("before"), F.array_join(F.slice(digests, F.col("at") + 2, F.size("children")), "").alias("after"))
        run = run.select("tree", "children", F.posexplode("children").alias("at", "child"), "subroot", "up")
        run = run.select("tree", "child", "subroot", F.concat(F.array(step).cast(PATH), "up").alias("up"))
        above = run.select("tree", F.col("child.place").alias("place"), "subroot", "up")
    if above is None:
        return done
    return done.unionByName(run.select("tree", *leaf("child"), "subroot", F.col("up").alias("path")))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda digest, x: F.sha2(F.concat(x.before, digest, x.after), 256))


@dataclass
class Manifest:
    """A dataset's trees, the tree over their roots, and the digest of all."""

    trees: Forest
    over: Forest
    root: str | None

    def nodes(self) -> DataFrame:
        """Every parent of every tree, to be written beside the data: tree ('' over the others), level, place, children."""
        columns = ["tree", "total", "level", "place", F.transform("children", lambda c: c.digest).alias("children")]
        return self.trees.links.select(columns).unionByName(self.over.links.select(columns))

    def proofs(self) -> DataFrame:
        """Rows (tree, leaf, doc, changed, subroot, path) of all leaves, with paths up to the root of all."""
        over = proofs(self.over, self.over.roots.select("tree", F.lit(None).cast("string").alias("subroot"), F.array().cast(PATH).alias("up")))
        return proofs(self.trees, over.select(F.col("doc").alias("tree"), F.col("leaf").alias("subroot"), F.col("path").alias("up")))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", changed: Column | None = None, arity: int = ARITY) -> Manifest:
    """The manifest of `docs`, a tree for each group; changed: a leaf's digest after tampering, null where it stays.

    Leaves ascend by id, rows without one first, rows of one id by their digest; equal rows are leaves of their own. A null
    group is a group of its own and the first; null, empty and long values are hashed whole. An empty table has no root
    (None). Columns that are not in `fields` are ignored.
    """
    shared = Shared(docs.sparkSession)
    tree = F.coalesce(F.concat(F.lit("s"), F.col(group_col).cast("string")), F.lit("n"))
    leaves = docs.select(tree.alias("tree"), F.col(id_col).alias("doc"), leaf_digest([F.col(c) for c in fields]).alias("digest"), (F.lit(None) if changed is None else changed).cast("string").alias("changed"))
    trees = build(ranked(leaves, "tree", ["doc", "digest"], shared, "leaves"), shared, "tree", arity)
    subroots = trees.roots.select(F.lit("").alias("tree"), F.col("tree").alias("doc"), F.element_at("children", 1).digest.alias("digest"), F.lit(None).cast("string").alias("changed"))
    over = build(ranked(subroots, "tree", ["doc"], shared, "subroots"), shared, "over", arity)
    root = over.roots.select(F.element_at("children", 1).digest.alias("root")).first()
    return Manifest(trees, over, root.root if root else None)


def verified_proofs(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", changed: Column | None = None, arity: int = ARITY) -> DataFrame:
    """One row per row of `docs`: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    folded_root comes from the changed leaf where there is one, and the siblings as they were. Edge cases as in manifest.
    """
    made = manifest(docs, fields, id_col, group_col, changed, arity)
    siblings = F.array_join(F.transform("path", lambda x: F.concat(x.before, x.after)), "")
    out = made.proofs().select(
        F.col("doc").alias(id_col), "leaf", "subroot", F.lit(made.root).cast("string").alias("root"), F.sha2(siblings, 256).alias("proof_sha256"), folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root")
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels of a tree in the SQL: 16 ** 6 leaves at most.
SQL_LEVELS = 6


def _sql() -> str:
    """The query's rows in DuckDB, level by level; crc32 bit by bit, for DuckDB has none."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    part = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(part(text if c == "text" else c) for c in FIELDS) + ")"
    crc = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ord(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
    steps = [
        f"d AS (SELECT doc_id, source, {leaf('text')} AS leaf, {leaf(lower)} AS low, coalesce({crc} % 5 = 0, false) AS hit FROM documents)",
        "a0 AS (SELECT coalesce('s' || source, 'n') AS tree, doc_id, leaf, CASE WHEN hit THEN low ELSE leaf END AS cur, '' AS proof, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d)",
        "n0 AS (SELECT tree, place, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM a0)",
    ]

    def climb(kind: str, nodes: str, rows: str) -> None:
        for k in range(1, SQL_LEVELS + 1):
            steps.append(f"{nodes}{k}r AS (SELECT tree, place // {ARITY} AS place, list(digest ORDER BY place) AS run, any_value(n) AS n FROM {nodes}{k - 1} GROUP BY ALL)")
            steps.append(f"{nodes}{k} AS (SELECT tree, place, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS digest, CASE WHEN n = 1 THEN 1 ELSE (n + {ARITY - 1}) // {ARITY} END AS n FROM {nodes}{k}r)")
            before, after = f"array_to_string(r.run[1:a.place % {ARITY}], '')", f"array_to_string(r.run[a.place % {ARITY} + 2:], '')"
            steps.append(f"{rows}{k} AS (SELECT a.* EXCLUDE (cur, proof, place), CASE WHEN r.n = 1 THEN a.cur ELSE sha256({before} || a.cur || {after}) END AS cur, CASE WHEN r.n = 1 THEN a.proof ELSE a.proof || {before} || {after} END AS proof, a.place // {ARITY} AS place FROM {rows}{k - 1} a JOIN {nodes}{k}r r ON a.{kind} = r.tree AND a.place // {ARITY} = r.place)")

    climb("tree", "n", "a")
    last = SQL_LEVELS
    steps.append(f"o0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS place, digest, count(*) OVER () AS n, tree AS source_tree FROM n{last})")
    steps.append(f"b0 AS (SELECT '' AS up, o.place, a.cur, a.proof, a.doc_id, a.leaf, o.digest AS subroot FROM a{last} a JOIN o0 o ON a.tree = o.source_tree)")
    climb("up", "o", "b")
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, leaf, subroot, o.digest AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = o.digest AS verified FROM b{last} JOIN o{last} o ON o.tree = up"


SQL = _sql()
