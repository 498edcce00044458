"""Near-duplicate classes by a token-group matrix.

A document's set holds its distinct word n-grams. Sets are brought into groups of similar ones; the matrix keeps for each
group the union of its members' tokens. For a query set, its overlap with a group's union bounds its overlap with every
member, so only groups whose bound reaches the threshold are opened and compared set by set. The classes are the connected
components of all links.

Steps. (1) Equal sets become one. (2) Three rounds bring sets with an equal pair of min-hashes together, in chunks, and link what is
similar in a chunk; the chunk's members then stand for their smallest member. What shares one more min-hash, linked or not,
forms groups of about ``CHUNK`` sets, those of one leader together: nothing later depends on what they miss. (3) Pivots: a pair of similar sets shares
one of its first tokens (prefix filter: n - ceil(t n) + 1 tokens in an order that puts frequent tokens last). Where more than ``CROWD`` sets
share one, each is first compared with one set of the largest family among them only, drawn anew for each token in ``ROUNDS`` rounds: a family
of near copies comes to one leader by a number of comparisons in proportion to its (token, set) rows. (4) Search: tokens whose
documents all stand for one leader are done with; those of the others name the (query, group) pairs, which
signatures of fixed size, the bound and then the comparison settle. (5) Components of the links between leaders.

Tokens and sets are told apart by 64-bit hashes. Tables stand in the checkpoint folder; bitmaps of fixed size thin out rows
before exact joins. No pair within a family is listed unless its groups are still apart.

Defined cases: null and empty texts, and texts of white space, have empty sets, linked with nothing, not even with each
other; fewer words than n form one token; a null id takes part, and its class is named by the others (null if alone);
repeated rows each get a row; an empty table gives an empty result; extra columns are ignored. Whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import cut, min_labels, shuffles_dropped, written
from flowspark.llm.hashing import Powers, bitmap, in_bitmap, rolling, word_hashes

SKETCH_BITS = 18
ROUNDS = 3
CHUNK = 64
CROWD = 16
QUERY_BLOCK = 256
BUCKET = 4096
_SEEDS = [np.uint64(s) for s in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
SIGNATURE = 1 << 10, 1 << 16  # bits, least and most


def shingles(text: str | None, n: int, powers: Powers) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of the words between ASCII white space, A-Z in lower case."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower(), powers)
    if not len(words):
        return words
    t = np.sort(rolling(words, min(n, len(words))))
    return t[np.concatenate([[True], t[1:] != t[:-1]])]


def set_key(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).view(np.int64))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    common = int(np.count_nonzero(large[at] == small))
    return 100 * common >= percent * (len(a) + len(b) - common)


def signature(tokens: np.ndarray) -> np.ndarray:
    """A bit for each place that an odd number of tokens falls on: two sets differ in at least as many tokens as their signatures in bits.

    There are about two places for each token, a power of two; a longer signature folds onto a shorter one."""
    bits = min(max(1 << int(2 * len(tokens) - 1).bit_length(), SIGNATURE[0]), SIGNATURE[1])
    odd = np.bincount(((tokens >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _fold(m: np.ndarray, length: int) -> np.ndarray:
    """Rows of signatures, twice as long at most, folded to ``length`` words."""
    return m if m.shape[1] == length else m[:, :length] ^ m[:, length:]


def _face_groups(percent: int):
    """applyInPandas function over some (gid, block): the queries whose signature is near that of a member with a greater leader."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sigs = pdf["sig"].to_numpy()
        gid, block, asked, words = pdf["gid"].to_numpy(), pdf["block"].to_numpy(), pdf["is_query"].to_numpy(dtype=bool), np.fromiter(map(len, sigs), np.int64, len(sigs))
        order = np.lexsort((words, asked, block, gid))
        sigs, gid, block, asked, words = sigs[order], gid[order], block[order], asked[order], words[order]
        n, leader, k = (pdf[c].to_numpy()[order] for c in ("n", "leader", "k"))
        same = (gid[1:] == gid[:-1]) & (block[1:] == block[:-1])
        starts = np.flatnonzero(np.concatenate([[True], ~same | (asked[1:] != asked[:-1]) | (words[1:] != words[:-1])]))
        ends = np.append(starts[1:], len(sigs))
        group = np.cumsum(np.concatenate([[True], ~same]))[starts]
        near = np.zeros(len(sigs), dtype=bool)
        members: list[tuple[int, int, np.ndarray]] = []  # signatures of equal length of the group at hand, which stand before its queries
        for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
            if i and group[i] != group[i - 1]:
                members = []
            if asked[a] and not members:
                continue
            sig = np.concatenate(sigs[a:b]).reshape(b - a, -1)
            if not asked[a]:
                members.append((a, b, sig))
                continue
            for low, high, m_sig in members:
                short = min(sig.shape[1], m_sig.shape[1])
                if max(sig.shape[1], m_sig.shape[1]) > 2 * short:
                    continue
                q, m = _fold(sig, short), _fold(m_sig, short)
                slab = max(1, (1 << 18) // q.size)
                for j in range(0, len(m), slab):
                    # counted unsigned: of a signed value numpy counts the bits of its absolute value
                    apart = np.bitwise_count((q[:, None] ^ m[None, j : j + slab]).view(np.uint64)).sum(axis=2, dtype=np.int64)
                    of = slice(low + j, min(low + j + slab, high))
                    near[a:b] |= (((100 + percent) * apart <= (100 - percent) * (n[a:b, None] + n[None, of])) & (leader[a:b, None] < leader[None, of])).any(axis=1)
        return pd.DataFrame({"gid": gid[near], "k": k[near]})

    return run


def _blocks(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """(gid, block, k, leader, is_query): queries of each group in blocks, the group's members beside every block."""
    blocks = pairs.groupBy("gid").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    asked = pairs.join(blocks, "gid").select("gid", F.pmod(F.xxhash64("k"), F.col("blocks")).alias("block"), "k", "leader", F.lit(True).alias("is_query"))
    held = groups.join(blocks, "gid").select("gid", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"), "k", "leader", F.lit(False).alias("is_query"))
    return asked.unionByName(held)


def _summaries(n: int):
    """mapInPandas function: one row per document, and per task the counts of its tokens in a fixed number of places.

    Min-hashes go in pairs: sets that are similar share one of the three pairs mostly, sets with one passage in common hardly ever."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers, counts = Powers(), np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        names = ["doc_id", "n", "k", *[f"m{j}" for j in range(ROUNDS)], "loose", "sig", "counts"]
        for b in batches:
            rows, all_tokens = [], []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                t = shingles(text, n, powers)
                if not len(t):
                    rows.append((doc_id, 0, 0, *[0] * ROUNDS, 0, None, None))
                    continue
                all_tokens.append((t >> np.uint64(64 - SKETCH_BITS)).astype(np.int32))
                mins = np.array([(t * s).min() for s in _SEEDS])
                pairs = (mins * _SEEDS[0] ^ np.roll(mins, 1)).view(np.int64).tolist()
                rows.append((doc_id, len(t), set_key(t), *pairs, int(mins[:1].view(np.int64)[0]), signature(t), None))
                if len(all_tokens) >= 500:
                    counts += np.bincount(np.concatenate(all_tokens), minlength=1 << SKETCH_BITS)
                    all_tokens.clear()
            if all_tokens:
                counts += np.bincount(np.concatenate(all_tokens), minlength=1 << SKETCH_BITS)
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
        yield pd.DataFrame([(None, -1, 0, *[0] * ROUNDS, 0, None, counts)], columns=names).astype({"doc_id": "Int64"})

    return run


def frequency_classes(counts: np.ndarray) -> np.ndarray:
    """For each place of the counts, 0 where nothing stands out, else the magnitude of what does."""
    usual = float(np.median(counts))
    noise = 6.0 * max(1.0, usual) ** 0.5
    return np.where(counts - usual < noise, 0, 1 + np.log2(np.maximum(counts - usual, noise) / noise)).astype(np.int64)


def _prefix(tokens: np.ndarray, percent: int, classes: np.ndarray) -> np.ndarray:
    """The tokens of which a similar set must share one: the first in the order of (frequency class, hash)."""
    n = len(tokens)
    length = n - -(-percent * n // 100) + 1
    cls = classes[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    return tokens[np.lexsort((tokens, cls))[:length]]


def _prefix_rows(n: int, percent: int, classes: np.ndarray, only: np.ndarray | None = None):
    """mapInPandas function: (token, k, n) for the prefix tokens of each distinct set of the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers, seen = Powers(), set()
        for b in batches:
            parts, keys, sizes = [], [], []
            for text in b["text"]:
                t = shingles(text, n, powers)
                if not len(t) or (k := set_key(t)) in seen:
                    continue
                seen.add(k)
                p = _prefix(t, percent, classes)
                if only is not None:
                    p = p[in_bitmap(only, p)]
                parts.append(p)
                keys.append(np.full(len(p), k, dtype=np.int64))
                sizes.append(np.full(len(p), len(t), dtype=np.int32))
            if parts:
                yield pd.DataFrame({"token": np.concatenate(parts).view(np.int64), "k": np.concatenate(keys), "n": np.concatenate(sizes)})

    return run


def _sets(docs: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """(k, tokens) of the wanted sets (k, low), once each; only texts whose id may be the least of a wanted set are hashed."""
    only, ids = bitmap(keys, "k"), bitmap(keys.where("low is not null"), "low", 23)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers, seen = Powers(), set()
        for b in batches:
            ks, ts = [], []
            maybe = b["doc_id"].isna().to_numpy() | in_bitmap(ids, b["doc_id"].fillna(0).to_numpy(dtype=np.int64).view(np.uint64))
            for text in b["text"][maybe]:
                t = shingles(text, n, powers)
                if not len(t) or (k := set_key(t)) in seen or not in_bitmap(only, np.array([k], dtype=np.int64).view(np.uint64))[0]:
                    continue
                seen.add(k)
                ks.append(k)
                ts.append(t.tobytes())
            yield pd.DataFrame({"k": np.array(ks, dtype=np.int64), "tokens": pd.Series(ts, dtype=object)})

    found = docs.select(F.col("doc_id"), "text").mapInPandas(run, "k long, tokens binary")
    return found.join(keys.select("k").distinct(), "k", "left_semi").dropDuplicates(["k"])


def _link_chunk(percent: int):
    """applyInPandas function: the members of a chunk that stand for a smaller member."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        keys, sets = pdf["k"].tolist(), [np.frombuffer(t, dtype=np.uint64) for t in pdf["tokens"]]
        heads: list[list[int]] = []
        out = []
        for i in range(len(keys)):
            met = [h for h in heads if any(similar(sets[i], sets[j], percent) for j in h)]
            if met:
                for h in met[1:]:
                    met[0].extend(h)
                    heads.remove(h)
                met[0].append(i)
            else:
                heads.append([i])
        for h in heads:
            low = min(h)
            out += [(keys[j], keys[low]) for j in h if j != low]
        return pd.DataFrame(out, columns=["k", "leader"]).astype("int64")

    return run


def _search_group(percent: int):
    """applyInPandas function: a group's members and some queries; the queries open the group if their bound allows it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        members = pdf[~pdf["is_query"]]
        mine = [np.frombuffer(t, dtype=np.uint64) for t in members["tokens"]]
        out = []
        if mine:
            union, least = np.unique(np.concatenate(mine)), min(map(len, mine))
            for k, raw, leader in pdf.loc[pdf["is_query"], ["k", "tokens", "leader"]].itertuples(index=False):
                q = np.frombuffer(raw, dtype=np.uint64)
                at = np.searchsorted(union, q)
                at[at == len(union)] = 0
                bound = int(np.count_nonzero(union[at] == q))
                if (100 + percent) * bound < percent * (len(q) + least):
                    continue
                out += [(k, m) for m, s, up in zip(members["k"], mine, members["leader"]) if leader < up and similar(q, s, percent)]
        return pd.DataFrame(out, columns=["k", "member"]).astype("int64")

    return run


def _links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, groups: DataFrame, n: int, percent: int) -> DataFrame:
    """(k, member) of similar sets: queries (gid, k, leader) and the members (gid, k, leader) of their groups with a greater leader."""
    # signatures rule most queries out before any set is read: similar sets differ in few tokens
    facing = cut(_blocks(pairs, groups))
    buckets = 1 + facing.count() // BUCKET
    facing = facing.join(nodes.select("k", "n", "sig"), "k").groupBy(F.pmod(F.xxhash64("gid", "block"), F.lit(buckets)).alias("bucket"))
    near = facing.applyInPandas(_face_groups(percent), "gid long, k long")
    work = cut(_blocks(cut(near.join(pairs, ["gid", "k"])), groups))
    wanted = cut(work.select("k").distinct().join(nodes.select("k", "low"), "k"))
    return work.join(_sets(docs, wanted, n), "k").groupBy("gid", "block").applyInPandas(_search_group(percent), "k long, member long").distinct()


def _merged(stands: DataFrame, edges: DataFrame) -> DataFrame:
    """(k, leader) after the links (a, b) between leaders."""
    labels = min_labels(edges).select(F.col("node").alias("leader"), "label")
    return stands.join(labels, "leader", "left").select("k", F.coalesce("label", "leader").alias("leader"))


def _between(links: DataFrame, stands: DataFrame) -> DataFrame:
    """The links (k, member) as links (a, b) between the leaders."""
    of = lambda side, name: stands.select(F.col("k").alias(side), F.col("leader").alias(name))
    return links.join(of("k", "a"), "k").join(of("member", "b"), "member").select("a", "b").distinct()


def _by_pivots(docs: DataFrame, nodes: DataFrame, hits: DataFrame, stands: DataFrame, n: int, percent: int) -> DataFrame:
    """(k, leader) after sets that share a token with many others met one set of the largest family among them.

    A round lists no more pairs than there are (token, set) rows; what stays apart is left to the search."""
    crowded = hits.groupBy("token").agg(F.count("*").alias("c"), F.min("leader").alias("lo"), F.max("leader").alias("hi")).where((F.col("c") > CROWD) & F.expr("lo <> hi"))
    crowd = cut(hits.join(crowded.select("token"), "token", "left_semi").select("token", "k"))
    for j in range(ROUNDS):
        families = stands.groupBy("leader").agg(F.count("*").alias("members"))
        here = cut(crowd.join(stands, "k").join(families, "leader"))
        pivots = here.groupBy("token").agg(F.max(F.struct("members", "leader", F.xxhash64("k", "token", F.lit(j)).alias("draw"), "k")).alias("pivot"), F.min("leader").alias("lo"), F.max("leader").alias("hi")).where("lo <> hi").select("token", "pivot")
        pairs = cut(here.join(pivots, "token").where("leader <> pivot.leader").select(F.col("pivot.k").alias("gid"), "k", F.lit(0).cast("long").alias("leader")).distinct())
        if pairs.isEmpty():
            break
        pivot = pairs.select("gid").distinct().select("gid", F.col("gid").alias("k"), F.lit(1).cast("long").alias("leader"))
        edges = written(_between(_links(docs, nodes, pairs, pivot, n, percent), stands), "links")  # read anew, since sizes that Spark estimates multiply with each join of a checkpoint
        if edges.isEmpty():
            break
        stands = written(_merged(stands, edges), "leaders")
    return stands


def _classes(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, k) of the rows and (k, component_id) of the sets, both materialised."""
    mins = ", ".join(f"m{j} long" for j in range(ROUNDS))
    seen = cut(docs.mapInPandas(_summaries(n), f"doc_id long, n long, k long, {mins}, loose long, sig array<long>, counts array<long>"))
    rows = seen.where("n >= 0").select("doc_id", "n", "k")
    places = seen.where("n < 0").select(F.posexplode("counts").alias("place", "c")).where("c > 0").groupBy("place").agg(F.sum("c").alias("c")).toArrow()
    counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    counts[places["place"].to_numpy()] = places["c"].to_numpy()
    classes = frequency_classes(counts)
    nodes = cut(seen.where("n > 0").groupBy("k").agg(F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("loose").alias("loose"), *[F.first(f"m{j}").alias(f"m{j}") for j in range(ROUNDS)]))

    # groups of similar sets: chunks of equal min-hash, three times over what still stands for itself
    needed = None
    for j in range(ROUNDS):
        crowd = nodes.groupBy(f"m{j}").agg(F.count("*").alias("c")).where("c > 1").select(f"m{j}")
        here = nodes.join(crowd, f"m{j}", "left_semi").select("k")
        needed = here if needed is None else needed.unionAll(here)
    sets = cut(_sets(docs, cut(nodes.join(needed.distinct(), "k", "left_semi").select("k", "low")), n))
    stands = nodes.select("k", F.col("k").alias("leader"))
    alone = nodes
    for j in range(ROUNDS):
        m = f"m{j}"
        crowd = alone.groupBy(m).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"), F.count("*").alias("c")).where("c > 1").drop("c")
        chunk = alone.join(crowd, m).select("k", m, F.pmod(F.xxhash64("k"), F.col("chunks")).alias("chunk"))
        moved = cut(chunk.join(sets, "k").groupBy(m, "chunk").applyInPandas(_link_chunk(percent), "k long, leader long"))
        step = moved.select(F.col("k").alias("leader"), F.col("leader").alias("up"))
        stands = stands.join(step, "leader", "left").select("k", F.coalesce("up", "leader").alias("leader"))
        alone = cut(alone.join(moved, "k", "left_anti"))
    stands = written(stands, "leaders")

    # tokens that lead from one leader's sets to another's
    shared = cut(docs.select("text").mapInPandas(_prefix_rows(n, percent, classes), "token long, k long, n int").groupBy("token").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo <> hi").select("token"))
    hits = docs.select("text").mapInPandas(_prefix_rows(n, percent, classes, bitmap(shared, "token", 23)), "token long, k long, n int")
    hits = cut(hits.join(shared, "token", "left_semi").join(stands, "k"))
    across = lambda: hits.groupBy("token").agg(F.min("leader").alias("lo"), F.max("leader").alias("hi")).where("lo <> hi").select("token")
    hits = cut(hits.join(across(), "token", "left_semi").distinct())
    stands = _by_pivots(docs, nodes, hits, stands, n, percent)

    # groups: a large family has its own, small ones share theirs with those of an equal min-hash; led by its greatest set, a large
    # family is asked by what stands apart from it (a query has the smaller leader) instead of asking with all members
    families = stands.groupBy("leader").agg(F.count("*").alias("members"), F.max("k").alias("top"))
    placed = cut(stands.join(families, "leader").select("k", "members", F.col("top").alias("leader")).join(nodes.select(F.col("k").alias("leader"), "loose"), "leader"))
    size = placed.where(F.col("members") <= CHUNK).groupBy("loose").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    own = F.xxhash64("leader", F.pmod(F.xxhash64("k"), F.ceil(F.col("members") / CHUNK)))
    groups = cut(placed.join(size, "loose", "left").select("k", "leader", F.when(F.col("members") > CHUNK, own).otherwise(F.xxhash64("loose", F.pmod(F.xxhash64("leader"), F.col("chunks")))).alias("gid")))
    hits = hits.drop("leader").join(groups, "k")
    hits = cut(hits.join(across(), "token", "left_semi"))
    matrix = hits.groupBy("token", "gid").agg(F.max("leader").alias("g_leader"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    near = hits.withColumnRenamed("gid", "own").join(matrix, "token").where((F.col("leader") < F.col("g_leader")) & (F.col("hi") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("lo") * percent))
    pairs = cut(near.select("gid", "k", "leader").distinct())
    edges = written(_between(_links(docs, nodes, pairs, groups.select("gid", "k", "leader"), n, percent), groups), "links")
    classes_of = _merged(groups, edges).withColumnRenamed("leader", "label")
    named = cut(classes_of.join(nodes.select("k", "low"), "k"))
    lowest = named.groupBy("label").agg(F.min("low").alias("component_id"))
    named = cut(named.join(lowest, "label").select("k", "component_id"))
    return rows, named


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per input row; sets link when 100 * common >= percent * all tokens of both."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    with shuffles_dropped(docs.sparkSession):
        rows, named = _classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), n, percent)
    full, empty = rows.where("n > 0"), rows.where("n = 0")
    out = full.join(named, "k").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(empty.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Of each class the rows of its smallest doc_id, all columns kept. Of repeated rows with that id one stays; rows without an id stay."""
    classes = near_duplicates(docs, n, percent).where("doc_id is not null and doc_id = component_id").select(F.col("doc_id").alias("_id")).distinct()
    named = docs.join(classes, docs["doc_id"] == F.col("_id"), "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id is null"))
