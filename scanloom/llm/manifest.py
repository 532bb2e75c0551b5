"""Merkle manifest of a dataset with nested-interval labels.

Every row is a leaf, every group (source) a tree over its leaves in key order, and a last
tree stands over the groups' roots. A node carries its level and the ranks ``[lo, hi)`` of
the leaves that it covers. A node's ancestor is found by its bucket, ``lo`` over the
ancestor's width, and containment; its siblings are the parent's interval without its own.

Nulls in any field are ``-``; a null group or key comes first. Rows that share a key are ordered
by their digest, so identical rows are interchangeable leaves; columns other than the fields are
ignored, whatever their names. Texts of any length are hashed where they are read and go
no further. An empty table has no leaves and no root.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.runs import scan
from scanloom.session import kept

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node.
FAN = 16


def field(c: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, colon, value."""
    own = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(own).cast("string"), F.lit(":"), own))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def _joined(kids: Column) -> Column:
    return F.array_join(F.transform(kids, lambda k: k.digest), "")


@dataclass
class Tree:
    """levels[l]: one row per group and node of level l + 1: ``grp, lo, hi, ends, kids, lone, digest``.

    kids: its children in order, ``(lo, hi, digest, item)``. ends: it covers the group's last leaf.
    lone: it has one child that is all of the group, so no node is built and the child is the group's root.
    """

    levels: list[DataFrame]

    def tops(self) -> DataFrame:
        """``grp, digest``: the root of every group."""
        parts = [t.where("lone").select("grp", F.col("kids")[0].digest.alias("digest")) for t in self.levels]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return whole

    def nodes(self) -> DataFrame:
        """``grp, level, lo, hi, digest, parent_lo, parent_hi`` of every leaf (level 0) and node below a parent."""
        parts = []
        for level, t in enumerate(self.levels):
            kid = t.select("grp", "lo", "hi", "lone", F.explode("kids").alias("k"))
            parent = lambda c: F.when(~F.col("lone"), F.col(c))
            parts.append(kid.select("grp", F.lit(level).alias("level"), "k.lo", "k.hi", "k.digest", parent("lo").alias("parent_lo"), parent("hi").alias("parent_hi")))
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return whole


def build(leaves: DataFrame, name: str = "tree", fan: int = FAN) -> Tree:
    """The trees of ``grp, at, digest, item`` (item: any column that goes with a leaf).

    One shuffle a level, each over a fan-th of the rows before, keyed by group and bucket: at most fan
    rows share a key, however large a group is.
    """
    ends = leaves.groupBy("grp").agg(F.max("at").alias("at"))
    nothing = F.lit(None).cast(leaves.schema["item"].dataType)
    rows = leaves.select("grp", F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"), "digest", "item", F.lit(False).alias("ends"))
    marks = ends.select("grp", F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"), F.lit(None).cast("string").alias("digest"), nothing.alias("item"), F.lit(True).alias("ends"))
    rows, levels, width = rows.unionByName(marks), [], fan
    while True:
        kid = F.when(F.col("digest").isNotNull(), F.struct("lo", "hi", "digest", "item"))
        up = rows.groupBy("grp", F.expr(f"lo div {width}").alias("bucket")).agg(F.array_sort(F.collect_list(kid)).alias("kids"), F.max("ends").alias("ends"))
        lo, hi = F.col("kids")[0].lo, F.element_at("kids", -1).hi
        lone = (F.col("bucket") == 0) & F.col("ends") & (F.size("kids") == 1)
        whole = kept(up.select("grp", lo.alias("lo"), hi.alias("hi"), "ends", "kids", lone.alias("lone"), F.when(~lone, F.sha2(_joined(F.col("kids")), 256)).alias("digest")), f"{name}-{len(levels) + 1}")
        levels.append(whole)
        if not whole.where("not lone").head(1):
            return Tree(levels)
        rows = whole.where("not lone").select("grp", "lo", "hi", "digest", F.lit(None).cast("string").alias("item"), "ends")
        width *= fan


def _siblings(lo: Column, hi: Column, kids: Column) -> Column:
    """What the parent's interval holds left and right of ``[lo, hi)``, as digests."""
    return F.struct(_joined(F.filter(kids, lambda k: k.hi <= lo)).alias("left"), _joined(F.filter(kids, lambda k: k.lo >= hi)).alias("right"))


def paths(tree: Tree, above: DataFrame, fan: int = FAN) -> DataFrame:
    """``grp, digest, item, subroot, path`` of every leaf; path: its siblings, level by level, ``(left, right)``.

    above: ``grp, subroot, above``, the path from every group's root on. From the top down every
    level's nodes meet their parents in the bucket of the parent's width and lie inside it.
    """
    parents, width = None, fan ** (len(tree.levels) + 1)
    for level, t in reversed(list(enumerate(tree.levels))):
        t = t if level == 0 else t.where("not lone")
        top = (F.col("lo") == 0) & F.col("ends")
        own = t.where(top).join(above, "grp").select("grp", "lo", "hi", "kids", "lone", "subroot", "above")
        if parents is not None:
            up = parents.select("grp", F.expr(f"lo div {width}").alias("bucket"), F.col("lo").alias("plo"), F.col("hi").alias("phi"), F.col("kids").alias("pkids"), "subroot", F.col("above").alias("pabove"))
            low = t.where(~top).withColumn("bucket", F.expr(f"lo div {width}")).join(up, ["grp", "bucket"]).where("plo <= lo and hi <= phi")
            path = F.concat(F.array(_siblings(F.col("lo"), F.col("hi"), F.col("pkids"))), F.col("pabove"))
            own = own.unionByName(low.select("grp", "lo", "hi", "kids", "lone", "subroot", path.alias("above")))
        parents, width = own, width // fan
    leaf = own.select("grp", "kids", "lone", "subroot", "above", F.explode("kids").alias("k"))
    path = F.when(F.col("lone"), F.col("above")).otherwise(F.concat(F.array(_siblings(F.col("k").lo, F.col("k").hi, F.col("kids"))), F.col("above")))
    return leaf.select("grp", "k.digest", "k.item", "subroot", path.alias("path"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s.left, h, s.right), 256))


def proof(path: Column) -> Column:
    """Digest of all siblings, level by level from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s.left, s.right)), ""), 256)


@dataclass
class Manifest:
    """leaves: ``grp, at, digest, item``; groups: the trees of all groups; top: the tree over their roots."""

    leaves: DataFrame
    groups: Tree
    top: Tree
    root: str | None


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: Sequence[str] = FIELDS, now: dict[str, Column] | None = None, fan: int = FAN) -> Manifest:
    """The manifest of all rows. item holds the key and ``now``, the leaf's digest with the fields in ``now``
    replaced (to verify another state of the rows against this one); without it, the digest itself."""
    own = [F.col(f) for f in fields]
    changed = digest(*((now or {}).get(f, F.col(f)) for f in fields)) if now else F.lit(None).cast("string")
    grp = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))  # ascends as the group does, null first
    leaves = kept(docs.select(grp.alias("grp"), F.col(key).alias("key"), digest(*own).alias("digest"), changed.alias("now")), "manifest-leaves")
    placed = scan(leaves, "grp", ["key", "digest"], name="manifest-ranks").select("grp", "at", "digest", F.struct("key", F.coalesce("now", "digest").alias("now")).alias("item"))
    groups = build(placed, "manifest-groups", fan)
    roots = groups.tops().select(F.lit("").alias("all"), "grp", "digest")
    over = scan(roots, "all", ["grp"], name="manifest-roots").select(F.col("all").alias("grp"), "at", "digest", F.struct(F.col("grp").alias("key")).alias("item"))
    top = build(over, "manifest-top", fan)
    root = top.tops().head()
    return Manifest(placed, groups, top, root.digest if root else None)


def verified(made: Manifest, key: str = "doc_id", fan: int = FAN) -> DataFrame:
    """``key, leaf, subroot, root, proof_sha256, folded_root, verified`` of every leaf.

    folded_root starts from the leaf's digest as it is now (``item.now``) and uses the manifest's siblings.
    """
    none = F.array().cast("array<struct<left:string,right:string>>")
    top = made.leaves.sparkSession.range(1).select(F.lit("").alias("grp"), F.lit(None).cast("string").alias("subroot"), none.alias("above"))
    above = kept(paths(made.top, top, fan).select(F.col("item.key").alias("grp"), F.col("digest").alias("subroot"), F.col("path").alias("above")), "manifest-above")
    rows = paths(made.groups, above, fan)
    out = rows.select(F.col("item.key").alias(key), F.col("digest").alias("leaf"), "subroot", F.lit(made.root).cast("string").alias("root"), proof(F.col("path")).alias("proof_sha256"), fold(F.col("item.now"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def lower_fifth(key: str = "doc_id", text: str = "text") -> Column:
    """The text with A-Z lowered in rows whose key's crc32 five divides: the tampering of the registered query."""
    hit = F.crc32(F.col(key).cast("string")) % 5 == 0
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(hit, F.translate(text, capitals, capitals.lower())).otherwise(F.col(text))
