"""N-gram Jaccard self-join by a token-group matrix, with connected components.

Documents are sets of word shingles.  Equal sets are one node.  Nodes are
partitioned into groups of similar sets, the matrix stores which tokens occur in
which group, a query's overlap with a group is bounded from the matrix, and only
groups whose bound reaches the needed overlap are opened and verified exactly:

1. Groups: nodes that share a min-hash (``GROUP_HASHES`` permutations) are
   compared with the one leader of that min-hash; verified links join nodes into
   groups (their components).  Linear in the nodes, whatever a group's size.  The first
   leader is the set with most copies; the queries of step 3 are compared once more with
   the one that has the fewest tokens of its own, the middle of a family whose members differ.
2. Matrix: of a set of n tokens the first n - ceil(t n) + n/10 in hash order can
   decide: linked sets share at least ``needed(n)`` of these (prefix lemma).
   A token found in one group only can't link across groups and drops out of
   the matrix, which leaves copied families without any cell.
3. Bound: a query with fewer than ``needed`` cells is closed at once.  The rest,
   a small part, get a matrix of their full sets.  There s of a query's n tokens
   occur in other groups; a query with s < t n is closed too, and two sets whose s
   and n can't give the threshold never meet, which separates the members of a
   family of distant copies.  Of the s tokens the most frequent are set aside: the
   rarest s - t n + 4 hold 4 shared ones (prefix lemma), so passages shared by many
   documents open nothing.  A pair is found by its larger set only: the smaller one
   shares 2 t n / (1 + t) of its tokens, so sets with a smaller s are not met, and
   the others by their rarest s - 2 t n / (1 + t) + 4 only.  A group qualifies if it
   holds t n of the query's tokens.
4. Open: the members of qualifying groups are verified on their full sets, and a
   last pass of components joins the groups.

Scale: sets stay in the text; only prefixes (a quarter of the tokens) are
shuffled, in one exchange for the counts and the cells, as (token, node, group)
without what a node's row holds; tokens that a sample shows to be frequent are dealt
out by node as well.  Joins on leaders are equi-joins that AQE can split.  Python workers get texts
in Arrow batches of ``BATCH_BYTES`` and work on ``RUN_BYTES`` of them at a time.
No pair inside a group is ever emitted.

Defined cases: a null text or one without words has an empty set and is linked
with nothing; fewer words than a shingle give the whole sequence as the one
token; repeated rows and exact copies are one node and get the same component;
the component id is the smallest non-null doc_id reachable (the row's own doc_id,
null included, where there is none); an empty table gives an empty result; other
input columns are ignored.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .store import BROADCAST_BYTES, keep, ship, small
from .worker import tidy

GROUP_HASHES = 4
#: Min-hashes that a node shares with a leader before the two are compared; which are not compared here are found from the matrix.
GROUP_SHARED = 2
#: Tokens that a query shares, among its rarest, with a group before the group's bound is computed.
RARE_SHARED = 4
HEAVY_SAMPLE = 64
HEAVY_SHARE = 0.005
HEAVY_LEAST = 16
#: Places among which the rows of a heavy token are dealt.
HEAVY_PARTS = 1024
#: Bytes of an Arrow batch of texts, and of the texts worked on at once.
BATCH_BYTES = 4 << 20
RUN_BYTES = 1 << 18
_SHORT = np.uint64(0x5851F42D4C957F2D)
PROFILE = "doc_id long, text_key long, n long, node long, check long, keys array<long>, prefix array<long>"


def needed(n, percent: int):
    """Prefix tokens that a set of n shares at least with any set linked to it."""
    return np.maximum(1, (percent * n // 100) // 10)


def _sets(run: W.Run, k: int):
    """Sorted distinct tokens of all rows, and the bounds of each row's."""
    hashes, rows = run.hashes(), run.rows
    token, at = W.grams(hashes, rows, k)
    row = rows[at]
    count = np.diff(run.bounds)
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        token = np.append(token, W.span_hashes(hashes, run.bounds[few], run.bounds[few + 1]) ^ _SHORT)
        row = np.append(row, few)
    order = np.lexsort((token, row))
    token, row = token[order], row[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
    token, row = token[new], row[new]
    return token, row, np.searchsorted(row, np.arange(run.n + 1))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _node(token, bounds):
    return W.mix(_sums(W.mix(token ^ np.uint64(0xA5A5)), bounds)), _sums(W.mix(token + np.uint64(77)), bounds)


def _profile(batches, k: int, percent: int):
    for batch in batches:
        for run in W.runs(batch.column("text"), lower=True, run_bytes=RUN_BYTES):
            token, row, bounds = _sets(run, k)
            n = np.diff(bounds)
            node, check = _node(token, bounds)
            some = np.flatnonzero(n)
            keys = np.zeros((run.n, GROUP_HASHES), np.uint64)
            for j in range(GROUP_HASHES if len(some) else 0):
                keys[some, j] = np.minimum.reduceat(W.mix(token ^ W._GRAM[40 + j]), bounds[some])
            size = np.minimum(n, n - -(-percent * n // 100) + np.maximum(1, n // 10))
            inside = np.arange(len(token)) - bounds[row] < size[row]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(run.first, run.n), batch.column("text_key").slice(run.first, run.n),
                pa.array(n.astype(np.int64)), pa.array(node.view(np.int64)), pa.array(check.view(np.int64)),
                W.list_array(keys.ravel(), np.arange(run.n + 1) * GROUP_HASHES),
                W.list_array(token[inside], np.append(0, np.cumsum(size)))], names=[x.split()[0] for x in PROFILE.split(", ")])


def _full(batches, k: int):
    for batch in batches:
        for run in W.runs(batch.column("text"), lower=True, run_bytes=RUN_BYTES):
            token, _, bounds = _sets(run, k)
            yield pa.RecordBatch.from_arrays([pa.array(_node(token, bounds)[0].view(np.int64)), W.list_array(token, bounds)], names=["node", "tokens"])


class TokenGroupJoin:
    """One join: its node table, full-set checks and steps; ``join`` below runs it."""

    def __init__(self, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str):
        ship(docs.sparkSession)
        self.k, self.percent = k, percent
        self.own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
        self.profile = keep(self.own.mapInArrow(lambda it: tidy(_profile(it, k, percent)), PROFILE), batch_bytes=BATCH_BYTES)
        filled = self.profile.where("n > 0")
        # one row stands for a node: the copy with the least text key and id
        self.nodes = keep(filled.groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least_id"), F.first("n").alias("n"), F.min("check").alias("check"),
                                                     F.min(F.struct("text_key", "doc_id")).alias("one")))
        if self.nodes.join(filled.select("node", "check"), "node").where(self.nodes["check"] != filled["check"]).limit(1).count():
            raise ValueError("two different shingle sets share a 64-bit node id; change the hash seed")

    def stand_ins(self, nodes: DataFrame) -> DataFrame:
        """Full token sets of the given nodes, computed again from the text of one copy each."""
        wanted = keep(self.nodes.join(nodes, "node", "left_semi").select("one.text_key", "one.doc_id").distinct())
        wanted = small(wanted, 48)
        same = (self.own.text_key == wanted.text_key) & self.own.doc_id.eqNullSafe(wanted.doc_id)
        k = self.k
        sets = self.own.join(wanted, same, "left_semi").select("text").mapInArrow(lambda it: tidy(_full(it, k)), "node long, tokens array<long>")
        return sets.dropDuplicates(["node"]) if self.repeated() else sets

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets meet the threshold, checked on full sets."""
        size = self.nodes.select("node", "n")
        pairs = pairs.join(size.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(
            size.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
        pairs = keep(pairs.where(100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb")).select("a", "b").distinct())
        sets = keep(self.stand_ins(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()), batch_bytes=BATCH_BYTES)
        bytes_ = sets.agg(F.sum(F.size("tokens") * 8 + 32).alias("n")).first()["n"] or 0
        if bytes_ <= BROADCAST_BYTES:
            first = second = F.broadcast(sets)
        else:  # the pairs go to the sets, which stay where they are on one side and are thinned out on the other
            pairs, first = small(pairs, 16), sets
            second = sets.join(pairs.select(F.col("a").alias("node")), "node", "left_semi")
        full = pairs.join(first.select(F.col("node").alias("b"), F.col("tokens").alias("b_tokens")), "b").join(
            second.select(F.col("node").alias("a"), F.col("tokens").alias("a_tokens")), "a")
        common = F.size(F.array_intersect("a_tokens", "b_tokens"))
        return full.where(100 * common >= self.percent * (F.size("a_tokens") + F.size("b_tokens") - common)).select("a", "b")

    def leader_links(self) -> DataFrame:
        """Verified links of nodes with the leader of each of their min-hashes: the set with most exact copies, as the likely origin."""
        return self.led(self.nodes.select("node", "copies"), "copies")

    def central_links(self, queries: DataFrame) -> DataFrame:
        """Verified links of queries with the one of each of their min-hashes that has the fewest tokens outside other groups."""
        return self.led(small(keep(queries.select("node", (-F.col("u")).alias("few"))), 24), "few")

    def led(self, nodes: DataFrame, by: str) -> DataFrame:
        """Verified links of ``nodes`` (node, by) with the one of each of their min-hashes that has the greatest ``by``."""
        keys = self.profile.where("n > 0").select("node", F.posexplode("keys").alias("j", "key"))
        keys = keep(keys.join(nodes, "node").distinct())
        leaders = keys.groupBy("j", "key").agg(F.max(F.struct(by, "node")).alias("m"), F.count("*").alias("n")).where("n > 1")
        leaders = leaders.select("j", "key", F.col("m.node").alias("leader"))
        pairs = keys.join(leaders, ["j", "key"]).where("node <> leader").groupBy(F.col("leader").alias("a"), F.col("node").alias("b")).count()
        return keep(self.verify(pairs.where(F.col("count") >= GROUP_SHARED).select("a", "b")))

    def spread(self, rows: DataFrame) -> DataFrame:
        """Matrix cells (token, node, n_rows) of ``rows`` (node, grp, tokens): tokens that occur in two groups or more.

        One exchange by token serves the counts and the cells.  Heavy tokens, in
        more than HEAVY_SHARE of a sample of the nodes, would make it uneven: they
        are dealt out by node too, are cells without a count and rank after all others.  There are at most tokens
        per node / HEAVY_SHARE of them, whatever the number of nodes.
        """
        sample = rows.where(F.pmod(F.xxhash64("node"), F.lit(HEAVY_SAMPLE)) == 0)
        counts = sample.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
        heavy = keep(counts.where(F.col("n") > max(HEAVY_LEAST, HEAVY_SHARE * sample.count())).select("token"))
        # most nodes are their own group: a null packs better than a second copy of the id
        all_ = rows.select(F.explode("tokens").alias("token"), "node", F.when(F.col("grp") != F.col("node"), F.col("grp")).alias("grp")).join(
            small(heavy, 8).withColumn("heavy", F.lit(True)), "token", "left")
        all_ = all_.select("token", "node", "grp", F.when(F.col("heavy"), F.pmod(F.xxhash64("node"), F.lit(HEAVY_PARTS)).cast("int")).alias("part"))
        place, own = Window.partitionBy("token", "part"), F.coalesce("grp", "node")
        cells = all_.withColumns({"low": F.min(own).over(place), "high": F.max(own).over(place), "n_rows": F.count("*").over(place).cast("int")})
        return cells.where("part is not null or low <> high").select(
            "token", "node", F.when(F.col("part").isNull(), F.col("n_rows")).otherwise(F.lit(2**31 - 1)).alias("n_rows"))

    def survivors(self, groups: DataFrame) -> DataFrame:
        """(node, grp, n, tokens): nodes whose prefix has ``needed`` cells, with their full sets."""
        one = small(self.nodes.select("node", "one.text_key", "one.doc_id"), 40)
        rows = self.profile.where("n > 0")
        rows = rows.join(one, (rows.node == one.node) & (rows.text_key == one.text_key) & rows.doc_id.eqNullSafe(one.doc_id), "left_semi")
        rows = rows.select("node", "prefix").dropDuplicates(["node"]) if self.repeated() else rows.select("node", "prefix")
        groups = small(groups, 16)
        own = self.nodes.select("node", "n").join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("grp"), "n")
        rows = rows.join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("grp"), F.col("prefix").alias("tokens"))
        need = F.greatest(F.lit(1), F.floor(F.floor(F.lit(self.percent) * F.col("n") / 100) / 10))
        first = self.spread(rows).groupBy("node").agg(F.count("*").alias("x"))
        first = keep(first.join(own, "node").where(F.col("x") >= need).select("node", "grp", "n"))
        return keep(self.stand_ins(first.select("node")).join(small(first, 24), "node").select("node", "grp", "n", "tokens"), batch_bytes=BATCH_BYTES)

    @cached_property
    def _repeated(self) -> bool:
        return self.profile.count() != self.profile.select("doc_id", "text_key").distinct().count()

    def repeated(self) -> bool:
        """Whether any (doc_id, text) occurs in two rows."""
        return self._repeated

    def least_share(self, n):
        return F.ceil(F.lit(self.percent) * n / 100).cast("int")

    def queries(self, groups: DataFrame) -> DataFrame:
        """Nodes whose tokens in other groups can be enough for a link: these tokens, rarest first, s of them and u others."""
        # of a pair the smaller set, by (n, node), shares so many of its tokens
        def smaller_share(n):
            return F.ceil(F.lit(2 * self.percent) * n / (100 + self.percent)).cast("int")

        left = self.survivors(groups)
        cells = self.spread(left).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n_rows", "token"))).alias("tokens"))
        cells = cells.join(left.select("node", "grp", "n"), "node").withColumns(
            {"s": F.size("tokens"), "need": self.least_share(F.col("n")), "need_less": smaller_share(F.col("n"))}).withColumn("u", F.col("n") - F.col("s"))
        return keep(cells.where("s >= need").withColumn("met", F.least(F.lit(RARE_SHARED), self.least_share(F.col("need")))))

    def opened(self, queries: DataFrame, groups: DataFrame) -> DataFrame:
        """Pairs of a node and the members of its qualifying groups whose sizes and own tokens allow a link.

        ``groups`` may have been joined further since ``queries`` were found: s is then an upper bound, as is all that follows from it.
        """
        # s tokens of a node occur in other groups, u = n - s don't: two nodes share min(s) at most, and have max(n + other's u) at least
        def possible(n, s, u, gn, gs, gu):
            return 100 * F.least(s, gs) >= self.percent * F.greatest(gn + u, n + gu)

        def rarest(need):
            return F.explode(F.slice("tokens", 1, F.col("s") - F.col(need) + F.least(F.lit(RARE_SHARED), F.col(need))))

        queries = queries.drop("grp").join(small(groups, 16), "node", "left").withColumn("grp", F.coalesce("component", "node")).drop("component")
        less = queries.where("s >= need_less")
        rare = queries.select("node", "grp", "n", "s", "u", "met", rarest("need").alias("x")).select(F.col("x.token").alias("token"), "node", "grp", "n", "s", "u", "met")
        best = less.groupBy(F.col("grp").alias("other")).agg(F.min("n").alias("gn"), F.max("s").alias("gs"), F.min("u").alias("gu"),
                                                             F.min(F.struct("n", "node")).alias("least"), F.count("*").alias("members"))
        other = less.select(rarest("need_less").alias("x"), F.col("grp").alias("other")).select("x.token", "other").distinct().join(best, "other")
        col = F.col
        reached = rare.join(other, (rare.token == other.token) & (col("grp") != col("other")) & (F.struct("n", "node") > col("least")) & possible(
            col("n"), col("s"), col("u"), col("gn"), col("gs"), col("gu"))).groupBy("node", "other").agg(
            F.count("*").alias("shared"), F.first("met").alias("met"), F.first("members").alias("members"))
        reached = keep(reached.where("shared >= met").select("node", "other", "members"))
        # a group of one is opened at once: its bound is the comparison itself
        matrix = less.select(F.col("grp").alias("other"), F.explode("tokens.token").alias("token")).distinct()
        bound = (reached.where("members > 1").join(queries.select("node", "need", F.col("tokens.token").alias("token")), "node")
                 .select("node", "other", "need", F.explode("token").alias("token"))
                 .join(matrix, ["token", "other"])
                 .groupBy("node", "other").agg(F.count("*").alias("overlap"), F.first("need").alias("need"))
                 .where("overlap >= need").select("node", "other"))
        bound = keep(bound.union(reached.where("members = 1").select("node", "other")))
        # the smaller sets of the qualifying groups
        a = bound.join(queries.select("node", "n", "s", "u"), "node").select(col("node").alias("a"), "other", "n", "s", "u")
        b = less.select(col("node").alias("b"), col("grp").alias("other"), col("n").alias("gn"), col("s").alias("gs"), col("u").alias("gu"))
        smaller = (col("gn") < col("n")) | ((col("gn") == col("n")) & (col("b") < col("a")))
        return a.join(b, "other").where(smaller & possible(col("n"), col("s"), col("u"), col("gn"), col("gs"), col("gu"))).select("a", "b")


def join(docs: DataFrame, id_col="doc_id", text_col="text", k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(documents, links): per input row doc_id, n_shingles and component_id; and spanning links: verified links
    between nodes that join each component, not all links (most of those inside a group are not listed)."""
    run = TokenGroupJoin(docs, k, percent, id_col, text_col)
    links = run.leader_links()
    groups = keep(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    queries = run.queries(groups)
    more = run.central_links(queries)
    if more.limit(1).count():
        links = links.union(more)
        groups = keep(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    more = keep(run.verify(run.opened(queries, groups)))
    links = links.union(more)
    if more.limit(1).count():
        groups = keep(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    named = run.nodes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    ids = keep(named.join(least, "component").select("node", "component_id"))
    out = run.profile.select("doc_id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(small(ids, 16), "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")), links


def jaccard_components(docs: DataFrame, id_col="doc_id", text_col="text", k: int = 5, percent: int = 80) -> DataFrame:
    return join(docs, id_col, text_col, k, percent)[0]
