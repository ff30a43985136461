"""A Merkle manifest of a table: one root for the whole, one subroot for each source, and short proofs for each row.

Leaves are hashes of rows, made by column functions. Sorted runs of them (Spark's range partitions) get their place within
their source from the counts of the runs before; a source of any share of the rows is spread over as many runs as it
needs. The node store is a folder of Parquet tables by level. Each level is made by one sequential pass over the one below:
tasks combine neighbours as they stream by. A run of neighbours that two tasks share is written as parts, which are put
together when the level is read; there are a few for each task, however many rows there are. No level is shuffled.

A proof is the list of what a row's hash is combined with on the way to the root: for each level the digests of the run in
order, with ``_`` where the own one goes. Proofs are extracted by a merge scan: nodes of ``DEPTH`` levels go to the block
of their coordinate, sorted from the top down, and a task that passes over them holds the nodes of one block (some
thousands). Trees of more levels are scanned in several steps, each beginning at the nodes where the one above ended. The
subroots are the leaves of a tree of their own, made and scanned by the same functions.

Defined cases: a null field is hashed as ``-``, other than an empty one; rows without a source are a source of their own, the
first one. Null ids come first. Rows of one id stand in the order of their leaves, and equal rows are leaves of their own,
which get each its proof. An empty table gives no rows and no root. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, read_table

#: Neighbours that become one node.
ARITY = 3
#: Levels of a block that a merge scan holds: 3^8 leaves and half as many nodes.
DEPTH = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value such that no other sequence of values reads alike: its length in bytes before it."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf leads to by the steps of a proof."""
    return F.aggregate(steps, start, lambda digest, step: F.sha2(F.replace(step, F.lit("_"), digest).cast("binary"), 256))


def proof_digest(steps: Column) -> Column:
    """The hash of all digests of a proof, without the own ones."""
    return F.sha2(F.replace(F.array_join(steps, ""), F.lit("_"), F.lit("")).cast("binary"), 256)


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the run and the row's place among those of its tree in the run."""
    run, tree, at = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        places = []
        for t in batch.column(0).to_pylist():
            at = at + 1 if t == tree else 0
            tree = t
            places.append(at)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([run] * len(places), pa.int32()), pa.array(places, pa.int64())], [*batch.schema.names, "run", "at"])


def schema_of(df: DataFrame) -> str:
    return ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes)


def placed(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(tree, key, hash, ...) with ``idx``, the row's place in its tree by (key, hash), and ``n``, the tree's rows."""
    # saved first: range partitions sample what they are made of
    rows = scratch.save(rows)
    runs = rows.repartitionByRange("tree", "key", "hash").sortWithinPartitions("tree", "key", "hash")
    runs = scratch.save(runs.mapInArrow(numbered, schema_of(runs) + ", run int, at long"))
    # one row for each run of a tree
    counts = runs.groupBy("tree", "run").agg(F.count("*").alias("c")).withColumnsRenamed({"tree": "t", "run": "r"})
    counts = counts.selectExpr("t", "r", "sum(c) OVER (PARTITION BY t ORDER BY r) - c AS before", "sum(c) OVER (PARTITION BY t) AS n")
    out = runs.join(counts, (F.col("tree") == F.col("t")) & (F.col("run") == F.col("r")))
    return out.select(*[c for c in rows.columns], (F.col("before") + F.col("at")).alias("idx"), "n").sortWithinPartitions("tree", "idx")


def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parents of neighbours that stream by: whole ones with their digest, others as parts, one for each child."""
    names = ["tree", "n", "idx", "hash", "children", "part"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.int32()]
    rows: list[tuple] = []
    key, first, held = None, 0, []

    def close() -> None:
        if key is None:
            return
        tree, n, parent = key
        above = -(-n // ARITY)
        if len(held) == min(ARITY, n - ARITY * parent):
            rows.append((tree, above, parent, digest(held), list(held), None))
        else:
            rows.extend((tree, above, parent, h, None, first % ARITY + k) for k, h in enumerate(held))

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for batch in batches:
        for tree, n, idx, h in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
            at = (tree, n, idx // ARITY)
            if at != key or idx != first + len(held):
                close()
                key, first, held = at, idx, []
            held.append(h)
        if rows:
            yield batch_of()
            rows.clear()
    close()
    if rows:
        yield batch_of()


class Nodes:
    """The node store of a forest: Parquet tables by level, level 0 the placed leaves."""

    def __init__(self, leaves: DataFrame, scratch: Scratch):
        self.tables = [scratch.save(leaves)]
        largest = self.tables[0].agg(F.max("n")).first()[0] or 1
        while largest > 1:
            largest = -(-largest // ARITY)
            below = self.level(len(self.tables) - 1).filter("n > 1").select("tree", "n", "idx", "hash")
            self.tables.append(scratch.save(below.mapInArrow(combined, "tree string, n long, idx long, hash string, children array<string>, part int")))

    def level(self, k: int) -> DataFrame:
        """tree, n, idx, hash and, above the leaves, children; parts are put together here."""
        table = self.tables[k]
        if k == 0:
            return table
        children = F.transform(F.array_sort(F.collect_list(F.struct("part", "hash"))), lambda x: x["hash"])
        parts = table.filter("part IS NOT NULL").groupBy("tree", "n", "idx").agg(children.alias("children"))
        parts = parts.select("tree", "n", "idx", F.sha2(F.array_join("children", "").cast("binary"), 256).alias("hash"), "children")
        return table.filter("part IS NULL").drop("part").unionByName(parts)

    def roots(self) -> DataFrame:
        """tree, level and hash of each tree's root."""
        found = [self.level(k).filter("n = 1").select("tree", F.lit(k).alias("level"), "hash") for k in range(len(self.tables))]
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out

    def proofs(self, above: DataFrame, scratch: Scratch) -> DataFrame:
        """The leaves with ``steps`` and ``subroot``; ``above`` has those of the roots (tree, level, subroot, steps)."""
        crown = None
        for s in range((len(self.tables) - 1) // DEPTH, -1, -1):
            bottom = s * DEPTH
            roots = above.filter(F.floor(F.col("level") / DEPTH) == s).select("tree", "level", F.lit(0).cast("long").alias("idx"), "subroot", "steps")
            known = roots if crown is None else roots.unionByName(crown)
            low = self.level(bottom).drop("children")
            keep = [c for c in low.columns if c not in ("tree", "n", "idx", "hash")] if s == 0 else []
            rows = known.select("tree", "level", "idx", F.lit(0).alias("kind"), "subroot", "steps")
            for k in range(bottom + 1, min(bottom + DEPTH, len(self.tables) - 1) + 1):
                rows = rows.unionByName(self.level(k).select("tree", F.lit(k).alias("level"), "idx", F.lit(1).alias("kind"), F.col("children").alias("steps")), allowMissingColumns=True)
            rows = rows.unionByName(low.select("tree", F.lit(bottom).alias("level"), "idx", F.lit(2).alias("kind"), F.col("hash").alias("leaf"), *keep), allowMissingColumns=True)
            block = F.floor(F.col("idx") / F.pow(F.lit(float(ARITY)), (bottom + DEPTH - F.col("level")).cast("double")))
            rows = rows.withColumn("block", block).repartition("tree", "block").sortWithinPartitions("tree", "block", F.desc("level"), "kind", "idx")
            out = rows.mapInArrow(scan, schema_of(rows))
            if s:
                crown = scratch.save(out.select("tree", "level", "idx", "subroot", "steps"))
        return out.drop("level", "kind", "block")


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 2 with the steps of their proof. A block's rows come from the top down: known proofs (kind 0), nodes with
    their children (1), then the rows asked for."""
    block, proofs, children = None, {}, {}

    def proof(level: int, idx: int) -> tuple[str, list[str]]:
        found = proofs.get((level, idx))
        if found is None:
            subroot, steps = proofs[level + 1, idx // ARITY]
            run, own = children[level + 1, idx // ARITY], idx % ARITY
            found = subroot, ["".join([*run[:own], "_", *run[own + 1 :]]), *steps]
        return found

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("tree", "block", "level", "idx", "kind", "subroot", "steps")]
        asked, subroots, steps_ = [], [], []
        for at, (tree, b, level, idx, kind, subroot, steps) in enumerate(zip(*columns, strict=True)):
            if (tree, b) != block:
                block = (tree, b)
                proofs.clear()
                children.clear()
            if kind == 0:
                proofs[level, idx] = subroot, steps
            elif kind == 1:
                proofs[level, idx] = proof(level, idx)
                children[level, idx] = steps
            else:
                subroot, steps = proof(level, idx)
                asked.append(at)
                subroots.append(subroot)
                steps_.append(steps)
        if asked:
            out = batch.take(pa.array(asked, pa.int64()))
            new = {"subroot": pa.array(subroots, pa.string()), "steps": pa.array(steps_, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(name, out.column(name)) for name in out.schema.names], out.schema.names)


def manifest(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, str | None]:
    """The proofs of rows (tree, key, hash, ...), and the root.

    ``tree`` is a string whose order is that of the subroots. Columns: tree, idx, leaf, subroot, steps, key and the further
    ones of ``rows``. Only the root comes to the driver.
    """
    nodes = Nodes(placed(rows, scratch), scratch)
    roots = scratch.save(nodes.roots())
    top = Nodes(placed(roots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "hash", F.col("tree").alias("of"), F.col("level").alias("height")), scratch), scratch)
    found = top.roots().first()
    if found is None:
        empty = rows.select("tree", F.lit(0).cast("long").alias("idx"), F.col("hash").alias("leaf"), F.col("hash").alias("subroot"), F.array("hash").alias("steps"), *[c for c in rows.columns if c not in ("tree", "hash")])
        return empty.filter("false"), None
    start = top.roots().select("tree", "level", F.col("hash").alias("subroot"), F.array().cast("array<string>").alias("steps"))
    above = scratch.save(top.proofs(start, scratch).select(F.col("of").alias("tree"), F.col("height").alias("level"), F.col("leaf").alias("subroot"), "steps"))
    return nodes.proofs(above, scratch), found["hash"]


def tree_of(source: Column) -> Column:
    """A key of the source that is never null and keeps the order: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def op12_merkle_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof, and the root that the document, changed or not, leads to by that proof. Line ends are taken
    out of the texts of documents whose id has an even checksum; those without an id aren't changed."""
    docs = read_table(spark, sf_dir, "documents")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    values = [F.col(c) for c in FIELDS[:-1]]
    rows = docs.select(tree_of(F.col("source")).alias("tree"), F.col("doc_id").alias("key"), leaf(*values, F.col("text")).alias("hash"), leaf(*values, text).alias("now"))
    out, root = manifest(rows, Scratch(spark, "op12"))
    out = out.select(F.col("key").alias("doc_id"), "leaf", "subroot", F.lit(root).alias("root"), proof_digest(F.col("steps")).alias("proof_sha256"), fold(F.col("now"), F.col("steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def climb_sql(name: str, start: str) -> str:
    """SQL of all levels over the leaves (tree, idx, n, h) of ``start``."""
    return f"""{name}(tree, k, idx, n, h) AS (SELECT tree, 0, idx, n, h FROM {start} UNION ALL
 SELECT tree, k + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY tree, k, idx // 3, n)"""


def walk_sql(name: str, start: str, nodes: str) -> str:
    """SQL of the way up from (num, tree, idx, digest, proof) of ``start``."""
    return f"""{name}_runs AS (SELECT tree, k, idx // 3 AS up, list(h ORDER BY idx) AS hs FROM {nodes} WHERE n > 1 GROUP BY ALL),
{name}(num, tree, k, pos, digest, proof) AS (SELECT num, tree, 0, idx, digest, proof FROM {start} UNION ALL
 SELECT num, f.tree, f.k + 1, pos // 3, sha256(array_to_string(list_concat(hs[1:pos % 3], [digest], hs[pos % 3 + 2:]), '')), proof || array_to_string(list_concat(hs[1:pos % 3], hs[pos % 3 + 2:]), '')
 FROM {name} f JOIN {name}_runs r ON r.tree = f.tree AND r.k = f.k AND r.up = pos // 3)"""


def leaf_sql(text: str) -> str:
    values = [f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in (*FIELDS[:-1], text)]
    return f"sha256(concat({', '.join(values)}))"


#: crc32 byte by byte and bit by bit, which the SQL engine has no function for.
CRC_SQL = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
 lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"""
OP12_SQL = f"""
WITH RECURSIVE d AS (SELECT *, CASE WHEN doc_id IS NOT NULL AND {CRC_SQL} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS now FROM documents),
l AS (SELECT doc_id, coalesce('=' || source, '-') AS tree, {leaf_sql("text")} AS h, {leaf_sql("now")} AS changed FROM d),
p AS (SELECT *, row_number() OVER () AS num, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM l),
{climb_sql("a", "p")},
r AS (SELECT '' AS tree, tree AS of, h, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM a WHERE n = 1),
{climb_sql("b", "r")},
{walk_sql("f", "(SELECT num, tree, idx, changed AS digest, '' AS proof FROM p)", "a")},
g AS (SELECT num, r.tree, r.idx, digest, proof FROM (SELECT num, tree AS of, arg_max(digest, k) AS digest, arg_max(proof, k) AS proof FROM f GROUP BY ALL) JOIN r USING (of)),
{walk_sql("t", "g", "b")},
z AS (SELECT num, arg_max(digest, k) AS digest, arg_max(proof, k) AS proof FROM t GROUP BY num)
SELECT doc_id, p.h AS leaf, r.h AS subroot, (SELECT h FROM b WHERE n = 1) AS root, sha256(proof) AS proof_sha256, digest AS folded_root, digest = (SELECT h FROM b WHERE n = 1) AS verified
FROM p JOIN z USING (num) JOIN r ON r.of = p.tree"""
