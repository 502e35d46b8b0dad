"""Merkle manifest of a dataset: a tree of digests for each language, one over these, and a proof for each row."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Nodes that one task takes in, and nodes left over that one task completes all trees from.
ROWS, CROWN = 8192, 32768


def digest(*inputs: str) -> str:
    return sha256("".join(inputs).encode()).hexdigest()


def width(n: int, level: int) -> int:
    """Nodes of a level of a tree of n leaves: each parent has two children, the last one perhaps one."""
    return -(-n >> level)


class Growth:
    """Nodes of one tree as they become known, bottom up.

    Each digest that comes is put into its parent under its own index. When a
    parent has as many children as the size of the level gives it, it becomes a
    node itself and goes on to its own parent; so one digest may complete a
    whole line of ancestors. Parents that stay partial leave their children
    open, for another task to match.
    """

    def __init__(self, n: int):
        self.n = n
        self.nodes: dict[tuple[int, int], str] = {}
        self.partial: dict[tuple[int, int], dict[int, str]] = {}

    def add(self, level: int, at: int, value: str) -> None:
        while True:
            self.nodes[level, at] = value
            size = width(self.n, level)
            if size == 1:
                return
            parent = level + 1, at >> 1
            children = self.partial.setdefault(parent, {})
            children[at] = value
            if len(children) < min(2, size - 2 * parent[1]):
                return
            del self.partial[parent]
            value = digest(*(children[i] for i in sorted(children)))
            level, at = parent

    def frontier(self) -> Iterator[tuple[int, int, str]]:
        """Nodes whose parent is still partial, and the root, if it is known."""
        for (level, _), children in self.partial.items():
            for at, value in children.items():
                yield level - 1, at, value
        top = (self.n - 1).bit_length()
        if (top, 0) in self.nodes:
            yield top, 0, self.nodes[top, 0]


class Proofs:
    """Reverse links: from a node to the siblings on its way to the root, shared by all nodes below."""

    def __init__(self, grown: Growth, above: dict[tuple[int, int], tuple]):
        self.grown, self.known = grown, dict(above)

    def __call__(self, level: int, at: int) -> tuple:
        """(side, sibling, rest): the side is where the sibling stands, N for none; () at the end."""
        found = self.known.get((level, at))
        if found is None:
            beside = at ^ 1
            link = ("N", "") if beside >= width(self.grown.n, level) else ("L" if beside < at else "R", self.grown.nodes[level, beside])
            found = self.known[level, at] = (*link, self(level + 1, at >> 1))
        return found


def unpack(path: str) -> tuple:
    """A proof from its text: each step a side and, but for N, the sibling's 64 digits."""
    steps, i = [], 0
    while i < len(path):
        steps.append((path[i], "" if path[i] == "N" else path[i + 1 : i + 65]))
        i += 1 if path[i] == "N" else 65
    out: tuple = ()
    for side, sibling in reversed(steps):
        out = (side, sibling, out)
    return out


def pack(proof: tuple) -> str:
    out = []
    while proof:
        side, sibling, proof = proof
        out += [side, sibling]
    return "".join(out)


def fold(leaf: str, proof: tuple) -> tuple[str, str]:
    """What the leaf and the siblings of the proof come to, and the digest of these siblings."""
    siblings = sha256()
    while proof:
        side, sibling, proof = proof
        siblings.update(sibling.encode())
        leaf = digest(sibling, leaf) if side == "L" else digest(leaf, sibling) if side == "R" else digest(leaf)
    return leaf, siblings.hexdigest()


_NODES = "task int, tree string, n long, level int, at long, value string"
_TOPS = "task int, tree string, level int, at long, path string, subroot string, root string"


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _grown(nodes: list[dict]) -> dict[str, Growth]:
    out: dict[str, Growth] = {}
    for r in nodes:
        if r["tree"] not in out:
            out[r["tree"]] = Growth(r["n"])
        out[r["tree"]].add(r["level"], r["at"], r["value"])
    return out


def _climbed(nodes: pa.Table) -> pa.Table:
    """What the nodes of one task leave open, and the roots that they reach."""
    rows = nodes.to_pylist()
    found = [(rows[0]["task"], tree, g.n, *node) for tree, g in _grown(rows).items() for node in g.frontier()]
    return _table(found, _NODES)


def _crowned(nodes: pa.Table) -> pa.Table:
    """All open nodes and roots there are, with their proofs: their trees are completed and one tree is grown over the roots."""
    rows = nodes.to_pylist()
    grown = _grown(rows)
    roots = {tree: g.nodes[(g.n - 1).bit_length(), 0] for tree, g in grown.items()}
    crown = Growth(len(roots))
    for at, tree in enumerate(sorted(roots, key=str.encode)):
        crown.add(0, at, roots[tree])
    top = (len(roots) - 1).bit_length()
    above = Proofs(crown, {(top, 0): ()})
    proofs = {tree: Proofs(grown[tree], {((grown[tree].n - 1).bit_length(), 0): above(0, at)}) for at, tree in enumerate(sorted(roots, key=str.encode))}
    return _table([(r["turn"], r["task"], r["tree"], r["level"], r["at"], pack(proofs[r["tree"]](r["level"], r["at"])), roots[r["tree"]], crown.nodes[top, 0]) for r in rows], f"turn int, {_TOPS}")


class Tops:
    """Proofs above one task's open nodes, by tree, with the tree's root and the root of all."""

    def __init__(self, rows: list[dict]):
        self.known: dict[str, dict[tuple[int, int], tuple]] = {}
        self.roots = {r["tree"]: (r["subroot"], r["root"]) for r in rows}
        for r in rows:
            self.known.setdefault(r["tree"], {})[r["level"], r["at"]] = unpack(r["path"])

    def proofs(self, nodes: list[dict]) -> dict[str, Proofs]:
        return {tree: Proofs(g, self.known[tree]) for tree, g in _grown(nodes).items()}


def _handed_down(nodes: pa.Table, tops: pa.Table) -> pa.Table:
    """Proofs of the nodes that a task took in, from those of the nodes that it left open."""
    rows, above = nodes.to_pylist(), Tops(tops.to_pylist())
    proofs = above.proofs(rows)
    return _table([(r["origin"], r["tree"], r["level"], r["at"], pack(proofs[r["tree"]](r["level"], r["at"])), *above.roots[r["tree"]]) for r in rows], _TOPS)


class Forest:
    """Trees over ordered leaves, and one tree over their roots.

    leaves: (tree, value, ...) with the columns `order`, which tell all rows of
    a tree apart. Rows are dealt to tasks by ranges of (tree, order), so that a
    tree of any size is spread evenly. Each task grows the ancestors that its
    own rows complete; the open nodes, some tens for each task, are dealt anew
    to fewer tasks until at most CROWN nodes are left. If these are too many
    roots, a forest of its own is grown over them.
    """

    def __init__(self, leaves: DataFrame, order: list[str]):
        self.tasks = max(1, -(-leaves.count() // ROWS))
        placed = self._placed(leaves, "tree", *order)
        each = placed.groupBy("task", "tree").agg(F.count("*").alias("rows"))
        of = Window.partitionBy("tree")
        before = F.sum("rows").over(of.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
        # one row for each task and tree: what lies before it, and the size of the tree
        self.starts = common.written(each.select("task", "tree", F.coalesce(before, F.lit(0)).alias("start"), F.sum("rows").over(of).alias("n")), "tree-starts")
        self.leaves, self.order, self.rounds = placed, order, []

        def first(rows: pa.Table, starts: pa.Table) -> pa.Table:
            return _climbed(_numbered(rows, starts, order))

        nodes = common.written(self._leaves_with(self.starts).applyInArrow(first, _NODES), "tree-nodes")
        is_root = F.expr("at = 0 and shiftleft(1L, level) >= n")
        ends = None
        while True:
            turned = nodes.withColumn("turn", F.lit(len(self.rounds)))
            every = turned if ends is None else ends.union(turned)
            if every.limit(CROWN + 1).count() <= CROWN:
                self.ends = every.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_crowned, f"turn int, {_TOPS}")
                break
            ends = turned.where(is_root) if ends is None else ends.union(turned.where(is_root))
            open_ = nodes.where(~is_root)
            many = open_.count()
            if not many:
                subroots = ends.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "value")
                above = common.written(Forest(subroots, ["of"]).prove(lambda r, proof, _, root: (r["of"], pack(proof), root), "of string, path string, root string"), "crown")
                self.ends = ends.join(above, F.col("tree") == F.col("of")).select("turn", "task", "tree", "level", "at", "path", F.col("value").alias("subroot"), "root")
                break
            # a task leaves nodes open only of the trees at its two ends, so half as many tasks hold them
            self.tasks = max(1, min(self.tasks // 2, -(-many // ROWS)))
            placed = self._placed(open_.withColumnRenamed("task", "origin").withColumn("first", F.expr("shiftleft(at, level)")), "tree", "first")
            self.rounds.append(placed)
            nodes = common.written(placed.drop("origin", "first").groupBy("task").applyInArrow(_climbed, _NODES), "tree-nodes")
        self.ends = common.written(self.ends, "tree-ends")

    def _placed(self, rows: DataFrame, *order: str) -> DataFrame:
        return common.written(rows.repartitionByRange(self.tasks, *order).withColumn("task", F.spark_partition_id()), "tree-tasks")

    def _leaves_with(self, other: DataFrame):
        return self.leaves.groupBy("task").cogroup(other.groupBy("task"))

    def prove(self, make, schema: str) -> DataFrame:
        """Rows that make(leaf row, proof, subroot, root) gives for each leaf.

        Proofs go down the way that the nodes came up: each round's tasks take
        the proofs of the nodes that they left open, grow their own nodes once
        more and hand on the proofs of what they took in.
        """
        order = self.order
        ended = lambda k: self.ends.where(F.col("turn") == k).drop("turn")
        tops = ended(len(self.rounds))
        for k in range(len(self.rounds) - 1, -1, -1):
            paths = self.rounds[k].groupBy("task").cogroup(tops.groupBy("task")).applyInArrow(_handed_down, _TOPS)
            tops = ended(k).union(common.written(paths, "tree-proofs"))
        # each leaf task gets its starts and the proofs above it in one table; level -1 marks a start
        starts = self.starts.select("task", "tree", F.lit(-1).alias("level"), F.col("start").alias("at"), F.col("n").cast("string").alias("path"), F.lit("").alias("subroot"), F.lit("").alias("root"))

        def last(rows: pa.Table, other: pa.Table) -> pa.Table:
            more = other.to_pylist()
            begin = pa.Table.from_pylist([{"tree": r["tree"], "start": r["at"], "n": int(r["path"])} for r in more if r["level"] < 0])
            nodes, above = _numbered(rows, begin, order).to_pylist(), Tops([r for r in more if r["level"] >= 0])
            proofs = above.proofs(nodes)
            return _table([make(r, proofs[r["tree"]](0, r["at"]), *above.roots[r["tree"]]) for r in nodes], schema)

        return self._leaves_with(starts.union(tops)).applyInArrow(last, schema)


def _numbered(rows: pa.Table, starts: pa.Table, order: list[str]) -> pa.Table:
    """Leaves of one task in their order, with n, level 0 and their index in the tree."""
    rows = rows.take(_sorted(rows, ["tree", *order]))
    begin = {r["tree"]: (r["start"], r["n"]) for r in starts.to_pylist()}
    at, n, seen = [], [], {}
    for tree in rows.column("tree").to_pylist():
        k = seen.get(tree, 0)
        seen[tree] = k + 1
        at.append(begin[tree][0] + k)
        n.append(begin[tree][1])
    zero = pa.array([0] * len(at), pa.int32())
    return rows.append_column("n", pa.array(n, pa.int64())).append_column("level", zero).append_column("at", pa.array(at, pa.int64()))


def _sorted(rows: pa.Table, order: list[str]) -> pa.Array:
    """Row numbers as Spark sorts them: null first, strings by their UTF-8 bytes."""
    columns = []
    for c in order:
        values = rows.column(c).to_pylist()
        columns.append([(v is not None, v.encode() if isinstance(v, str) else v if v is not None else 0) for v in values])
    return pa.array(sorted(range(len(rows)), key=lambda i: [c[i] for c in columns]), pa.int64())


def field(c: Column) -> Column:
    """`-` for null, else the value's UTF-8 byte count, a colon and the value."""
    c = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def leaf(n_chars: Column) -> Column:
    return F.sha2(F.concat(*(field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")))), 256)


_MANIFEST = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of documents.

    A leaf is the digest of a row's five fields, null told apart from empty.
    The leaves of each language stand in the order of doc_id, null first, equal
    ids in the order of their leaves; each two in a row have one parent, the
    last may be alone, up to the subroot. Subroots stand in the order of lang,
    null first. folded_root is what the row as it is now, and the siblings on
    its way, come to: where `changed` holds, the row counts as altered
    (n_chars greater by one; a null stays), and verified tells whether the
    proof still holds.

    Rows equal in all fields have leaves of their own; they are counted before
    the shuffle and dealt out again, so that copies do not meet in one task.
    Other columns are not read. An empty table gives no rows.
    """
    common.small_batches(docs.sparkSession)
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    rows = docs.select(F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("n_chars")).alias("value"), F.when(F.coalesce(changed if changed is not None else F.lit(False), F.lit(False)), leaf(more)).alias("altered"))
    rows = common.written(rows.groupBy("tree", "doc_id", "value", "altered").agg(F.count("*").alias("many")), "leaves")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("many")))).drop("many")

    def made(r: dict, proof: tuple, subroot: str, root: str) -> tuple:
        folded, siblings = fold(r["altered"] or r["value"], proof)
        return r["doc_id"], r["value"], subroot, root, siblings, folded, folded == root

    return Forest(rows, ["doc_id", "value", "copy"]).prove(made, _MANIFEST)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, where those whose id's checksum 7 divides have been tampered with; as manifest() says."""
    return manifest(common.documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string")) % 7 == 0)


def op13_sql(levels: int = 24) -> str:
    """The levels one after the other, for trees of up to 2^levels leaves. The rows to alter come from a bitwise checksum."""
    f = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf_ = lambda n: "sha256(" + " || ".join(f(c) for c in ("doc_id", "source", "lang", n, "text")) + ")"
    step = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    table = "SELECT i, c FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, k: " + step + ") AS c FROM range(256) t(i))"
    crc = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: xor(c >> 8, list_extract(tab, CAST(xor(c & 255, x) + 1 AS BIGINT)))), 4294967295)"
    sql = f"""
WITH w AS (SELECT list(c ORDER BY i) AS tab FROM ({table})),
d AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '') AS t, {leaf_('n_chars')} AS leaf, CASE WHEN {crc} % 7 = 0 THEN {leaf_('(n_chars + 1)')} ELSE {leaf_('n_chars')} END AS now FROM documents, w),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),"""

    def tree(name: str, first: str) -> str:
        out = f"\n{name}0 AS MATERIALIZED ({first}),"
        for k in range(levels):
            out += f"\n{name}{k + 1} AS MATERIALIZED (SELECT t, i // 2 AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, count(*) OVER (PARTITION BY t) AS n FROM {name}{k} GROUP BY t, i // 2),"
        return out

    def climb(name: str, nodes: str, first: str) -> str:
        out = f"\n{name}0 AS MATERIALIZED ({first}),"
        for k in range(levels):
            out += f"""
{name}{k + 1} AS MATERIALIZED (SELECT x.* REPLACE (CASE WHEN m.n = 1 THEN x.h WHEN s.h IS NULL THEN sha256(x.h) WHEN x.i % 2 = 1 THEN sha256(s.h || x.h) ELSE sha256(x.h || s.h) END AS h, x.proof || coalesce(s.h, '') AS proof, x.i // 2 AS i)
 FROM {name}{k} x JOIN {nodes}{k} m ON m.t = x.t AND m.i = x.i LEFT JOIN {nodes}{k} s ON s.t = x.t AND s.i = xor(x.i, 1)),"""
        return out

    sql += tree("a", "SELECT t, i, leaf AS h, count(*) OVER (PARTITION BY t) AS n FROM l")
    sql += tree("b", f"SELECT '' AS t, row_number() OVER (ORDER BY t) - 1 AS i, h, count(*) OVER () AS n FROM a{levels}")
    sql += climb("p", "a", "SELECT doc_id, leaf, t, i, now AS h, '' AS proof FROM l")
    sql += f"\nu AS (SELECT t, h, row_number() OVER (ORDER BY t) - 1 AS i FROM a{levels}),"
    sql += climb("q", "b", f"SELECT p.doc_id, p.leaf, u.h AS subroot, '' AS t, u.i, p.h, p.proof FROM p{levels} p JOIN u USING (t)")
    return sql + f"\nr AS (SELECT h AS root FROM b{levels}) SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM q{levels}, r\n"
