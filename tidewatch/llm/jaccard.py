"""Near duplicates by an n-gram Jaccard join over a token-group matrix.

A document is the set of its shingles of ``shingle`` words; documents with equal sets are one node.
Two nodes of sizes a and b that share ``percent`` of their union differ in few shingles, (a + b) / 9
at 80 %. So if shingles are dealt by hash into ``spare`` more parts than that, at least so many parts
hold the same shingles in both, and one of those isn't empty unless both have so many empty parts. Nodes
therefore meet in signatures (size band, part, hash of the part's shingles), which loses no link
and which common words or passages don't make meet. Sizes are in bands of a factor of two; two
sizes on either side of a band's edge meet in signatures of the edge, which only sizes near it have.

Nodes that share a signature are put into groups around its smallest node; a node that shares a
signature with a group that isn't its own queries it. Two nodes over the threshold share ``need``
signatures at least, so a node asks by all but its need - 1 signatures of the most groups, which
keeps signatures that many groups share from being asked without losing a pair. Groups meet twice:
first with rows of the token matrix, a few bits for each shingle, which leave the nodes that may
have a partner; then with these nodes' shingles. There each group has the union of its shingles,
and is opened to a query only if the overlap with the union can reach the threshold for the
group's smallest node. In an opened group shingles are counted exactly: one central node against
all, then every node that isn't connected with it, against all. What is left out are pairs within
one component, whose links change no component. Groups are cut into chunks of ``chunk`` nodes (rows
of the matrix: eight times as many) or CHUNK_BYTES, each with the group's centre, and their queries
into slices of the same bounds; nodes that aren't connected with the centre then query the other
chunks. Components come from label propagation over the links.

Shingles count as equal if their 64-bit hashes are; sets if their sizes and 64-bit sums are.

Defined cases: null and empty texts have no shingles, and no links; a text of fewer words than
a shingle is one shingle; repeated rows with one id are one document; rows without an id have no links and a
null component; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.bits import in_table, marked, table_of
from tidewatch.llm.common import compact, small_batches, tidy, tidy_group
from tidewatch.llm.components import connected_components
from tidewatch.llm.hashing import END, mix, token_hashes
from tidewatch.session import ensure_checkpoint_dir, table

#: Least similarity is PERCENT / 100; words in a shingle. op3's contract asks for 90 and 3.
PERCENT, SHINGLE = 80, 5
#: Nodes, and bytes of shingles, in a chunk of a group and in a slice of its queries.
CHUNK, CHUNK_BYTES = 500, 16_000_000
#: Parts to spare, and times the expected number of empty ones that are spared, too.
SPARE, EMPTY = 3, 1.6

_U = np.uint64


def shingle_sets(texts: list[str | None], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash) of all distinct shingles, sorted by both."""
    w, d = token_hashes(texts)
    real = w != END
    w, d = w[real], d[real]
    size = np.bincount(d, minlength=len(texts))
    first = np.r_[0, np.cumsum(size)][:-1]
    with np.errstate(over="ignore"):
        value = lambda at, k: mix(w[at + k] + _U(k + 1) * _U(0xA24BAED4963EE407))
        place = np.arange(len(w)) - first[d]
        full = np.flatnonzero(place + n <= size[d])
        total = np.zeros(len(full), np.uint64)
        for k in range(n):
            total = mix(total ^ value(full, k))
        part = np.flatnonzero((size > 0) & (size < n))
        short = np.zeros(len(part), np.uint64)
        for k in range(n - 1):
            has = size[part] > k
            short[has] = mix(short[has] ^ value(first[part[has]], k))
        short = mix(short ^ _U(n) ^ size[part].astype(np.uint64))
    doc, hashed = np.r_[d[full], part], np.r_[total, short]
    order = np.lexsort((hashed, doc))
    doc, hashed = doc[order], hashed[order]
    new = np.r_[True, (np.diff(doc) != 0) | (hashed[1:] != hashed[:-1])] if len(doc) else np.zeros(0, bool)
    return doc[new], hashed[new]


def _segment_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.r_[_U(0), np.cumsum(values)]
    with np.errstate(over="ignore"):
        return total[ends] - total[np.r_[0, ends[:-1]]]


def node_ids(doc: np.ndarray, hashed: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Size of each text's set, and its node: a hash of the set."""
    size = np.bincount(doc, minlength=texts)
    with np.errstate(over="ignore"):
        return size, mix(_segment_sums(mix(hashed), np.cumsum(size)) + size.astype(np.uint64)).astype(np.int64)


def bands(upto: int) -> np.ndarray:
    """First sizes of bands. Sizes in the ratio of a threshold of at least a half are in one band or in neighbours."""
    return 1 << np.arange(max(1, int(upto)).bit_length() + 2)


def _differ(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that are in one of two sets over the threshold alone, at most."""
    return (a + b) * (100 - percent) // (100 + percent)


def _dealt(doc: np.ndarray, hashed: np.ndarray, size: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For a text's band and for the edges near its size: text number, signature and emptiness of each part, and each text's parts to spare."""
    first = bands(size.max(initial=1))
    band = np.searchsorted(first, size, side="right") - 1
    ways = [(2 * band, first[band], _differ(first[band + 1] - 1, first[band + 1] - 1, percent), size > 0)]
    for at in (band, band + 1):
        edge = first[at]
        near = (size > 0) & (at > 0) & np.where(size < edge, 100 * size >= percent * edge, 100 * (edge - 1) >= percent * size)
        ways.append((2 * at + 1, edge * percent // 100, _differ(edge - 1, 100 * (edge - 1) // percent, percent), near))
    for kind, smallest, differ, use in ways:
        # With more than the expected empty parts to spare, few sets need signatures of empty parts, which meet at random.
        often_empty = np.exp(-np.maximum(smallest, 1) / np.maximum(differ, 1))
        spare = SPARE + np.ceil(EMPTY * differ * often_empty).astype(np.int64)
        parts = np.where((differ > 0) & use, differ + spare, 0)
        start = np.r_[0, np.cumsum(parts)]
        own = parts[doc] > 0
        d, h = doc[own], hashed[own]
        with np.errstate(over="ignore"):
            at = start[d] + (mix(h + _U(0x2545F4914F6CDD1D)) % parts[d].astype(np.uint64)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            n = np.bincount(at, minlength=start[-1])
            sums = _segment_sums(mix(h[order] ^ _U(0x94D049BB133111EB)), np.cumsum(n))
            of = np.repeat(np.arange(len(size)), parts)
            part = np.arange(start[-1]) - start[of]
            sign = mix(mix(sums + n.astype(np.uint64)) ^ mix(kind[of].astype(np.uint64) * _U(1 << 32) + part.astype(np.uint64)))
        yield of, sign, n == 0, np.where(parts > 0, spare, 1 << 30)


def signatures(doc: np.ndarray, hashed: np.ndarray, size: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(text number, signature) of all texts; two sets over the threshold share at least one."""
    out_doc, out_sign = [], []
    for of, sign, empty, spare in _dealt(doc, hashed, size, percent):
        many_empty = np.bincount(of[empty], minlength=len(size)) >= spare
        use = ~empty | many_empty[of]
        out_doc.append(of[use])
        out_sign.append(sign[use])
    return np.concatenate(out_doc), np.concatenate(out_sign).astype(np.int64)


def least_shared(doc: np.ndarray, hashed: np.ndarray, size: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """For each text how many signatures it shares at least with any other set over the threshold."""
    return np.minimum.reduce([np.maximum(1, spare - np.bincount(of[empty], minlength=len(size))) for of, _, empty, spare in _dealt(doc, hashed, size, percent)])


def _signatures(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a task gives a node's signatures once
        for batch in batches:
            doc, hashed = shingle_sets(batch.column("text").to_pylist(), shingle)
            size, node = node_ids(doc, hashed, batch.num_rows)
            _, at = np.unique(node, return_index=True)
            new = np.zeros(batch.num_rows, bool)
            new[[i for i in at if int(node[i]) not in seen]] = True
            seen.update(node[new].tolist())
            of, sign = signatures(doc, hashed, np.where(new, size, 0), percent)
            yield pa.RecordBatch.from_arrays([pa.array(sign), pa.array(node[of])], ["sign", "node"])

    return run


NODES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("need", pa.int32()), ("bits", pa.binary())])


def parities(doc: np.ndarray, hashed: np.ndarray, size: np.ndarray) -> list[bytes]:
    """A row of the token matrix for each text: shingles folded into a power of two of bits, two for each shingle at least, a bit for an odd number."""
    width = 1 << np.ceil(np.log2(2 * np.maximum(size, 32))).astype(np.int64)
    start = np.r_[0, np.cumsum(width)]
    odd = np.bincount(start[doc] + (hashed % width[doc].astype(np.uint64)).astype(np.int64), minlength=start[-1]) & 1
    packed = np.packbits(odd.astype(np.uint8), bitorder="little")
    return [packed[x // 8 : y // 8].tobytes() for x, y in zip(start[:-1], start[1:], strict=True)]


def _nodes(wanted: np.ndarray, shingle: int, percent: int):
    """Each text's node; rows of the token matrix, for nodes that may have a partner, go with the first of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            doc, hashed = shingle_sets(batch.column("text").to_pylist(), shingle)
            size, node = node_ids(doc, hashed, batch.num_rows)
            wants = (size > 0) & in_table(wanted, node) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(wants):
                wants[i] = int(node[i]) not in seen
                seen.add(int(node[i]))
            need = least_shared(doc, hashed, np.where(wants, size, 0), percent)
            number = np.cumsum(wants) - 1
            own = wants[doc]
            rows = parities(number[doc[own]], hashed[own], size[wants]) if wants.any() else []
            bits = [rows[number[i]] if wants[i] else None for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(node, pa.int64(), mask=size == 0), pa.array(np.minimum(need, 1 << 20), pa.int32()), pa.array(bits, pa.binary())], schema=NODES)

    return run


def _sets(wanted: np.ndarray, shingle: int):
    """Shingles of the nodes that may be in a table, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            doc, hashed = shingle_sets(batch.column("text").to_pylist(), shingle)
            size, node = node_ids(doc, hashed, batch.num_rows)
            ends = np.cumsum(size)
            nodes, raw = [], []
            for i in np.flatnonzero((size > 0) & in_table(wanted, node)):
                if int(node[i]) not in seen:
                    seen.add(int(node[i]))
                    nodes.append(int(node[i]))
                    raw.append(hashed[ends[i] - size[i] : ends[i]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(raw, pa.binary())], ["node", "shingles"])

    return run


def partnered(size: np.ndarray, bits: list[bytes], percent: int = PERCENT, first: int = 0) -> np.ndarray:
    """Whether a set may be over the threshold with another one; number ``first`` meets the others before they meet each other.

    Each bit in which two rows of the token matrix differ stands for a shingle that only one set has,
    so no pair over the threshold is lost. Wider rows are folded to meet narrower ones.
    """
    found = np.zeros(len(size), bool)
    wide = np.array([len(b) for b in bits])
    for w in np.unique(wide):
        own = np.flatnonzero((wide == w) | (wide == 2 * w))
        matrix = np.zeros((len(own), w // 8), np.uint64)
        for n, i in enumerate(own):
            row = np.frombuffer(bits[i], np.uint64)
            matrix[n] = row if wide[i] == w else row[: w // 8] ^ row[w // 8 :]
        for n in sorted(range(len(own)), key=lambda n: (own[n] != first, own[n])):
            if found[own[n]] or wide[own[n]] != w:
                continue
            off = np.bitwise_count(matrix ^ matrix[n]).sum(axis=1)
            near = off <= _differ(size[own], size[own[n]], percent)
            near[n] = False
            found[own[near]] = True
            found[own[n]] = near.any()
    # A wide set without a partner of its width may have narrower ones.
    for i in np.flatnonzero(~found):
        narrow = np.flatnonzero(2 * wide == wide[i])
        if len(narrow):
            row = np.frombuffer(bits[i], np.uint64)
            row = row[: len(row) // 2] ^ row[len(row) // 2 :]
            off = np.bitwise_count(np.stack([np.frombuffer(bits[n], np.uint64) for n in narrow]) ^ row).sum(axis=1)
            found[i] = (off <= _differ(size[narrow], size[i], percent)).any()
    return found


def _each(key: Sequence[str], chunks: pd.DataFrame, queries: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of each chunk of a bin, and of its queries."""
    of: dict[tuple, tuple[list[int], list[int]]] = {}
    for n, k in enumerate(zip(*(chunks[c] for c in key), strict=True)):
        of.setdefault(k, ([], []))[0].append(n)
    for n, k in enumerate(zip(*(queries[f"q_{c}"] for c in key), strict=True)):
        if k in of:
            of[k][1].append(n)
    for mine, asks in of.values():
        yield np.array(mine), np.array(asks, np.int64)


def _sift(percent: int):
    """Nodes of chunks and of their queries that may have a partner in the chunk."""

    def run(chunks: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        size = np.r_[chunks["size"].to_numpy(np.int64), queries["q_size"].to_numpy(np.int64)]
        node = np.r_[chunks["node"].to_numpy(np.int64), queries["q_node"].to_numpy(np.int64)]
        bits, found = [*chunks["bits"], *queries["q_bits"]], [np.empty(0, np.int64)]
        for mine, asks in _each(GROUP, chunks, queries):
            at = np.r_[mine, asks + len(chunks)]
            _, first = np.unique(node[at], return_index=True)
            at = at[first]
            if len(at) > 1:
                found.append(node[at[partnered(size[at], [bits[i] for i in at], percent)]])
        return pd.DataFrame({"node": np.unique(np.concatenate(found))})

    return run


def links(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between sets that connect all that are connected; centre first, then whatever isn't connected with it."""
    size = np.array([len(s) for s in sets])
    token, at = np.unique(np.concatenate(sets), return_inverse=True)
    of = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(at, kind="stable")
    postings, ends = of[order], np.cumsum(np.bincount(at, minlength=len(token)))
    starts = np.r_[0, ends[:-1]]
    often = (ends - starts)[at]
    cut = np.r_[0, np.cumsum(size)]
    root = np.arange(len(sets))

    def expand(i: int) -> list[tuple[int, int]]:
        mine = at[cut[i] : cut[i + 1]]
        mine = mine[often[cut[i] : cut[i + 1]] > 1]
        n = ends[mine] - starts[mine]
        flat = np.repeat(starts[mine] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        both = np.bincount(postings[flat], minlength=len(sets))
        near = 100 * both >= percent * (size[i] + size - both)
        near[i] = False
        found = []
        for j in np.flatnonzero(near):
            a, b = root[i], root[j]
            if a != b:
                root[root == b] = a
                found.append((i, int(j)))
        return found

    centre = int(np.argmax(np.bincount(of, weights=often) / np.maximum(size, 1)))
    out = expand(centre)
    for i in range(len(sets)):
        if root[i] != root[centre]:
            out += expand(i)
    return out


def _opened(nodes: np.ndarray, sets: list[np.ndarray], ask: np.ndarray, asking: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links of a chunk's nodes and of the queries that its union lets in."""
    union, least = np.unique(np.concatenate(sets)), min(map(len, sets))
    known, nodes, sets = set(nodes.tolist()), nodes.tolist(), list(sets)
    for node, s in zip(ask.tolist(), asking, strict=True):
        at = np.minimum(np.searchsorted(union, s), len(union) - 1)
        overlap = int((union[at] == s).sum())
        if node not in known and (100 + percent) * overlap >= percent * (len(s) + max(least, len(s) * percent // 100)):
            known.add(node)
            nodes.append(node)
            sets.append(s)
    return [(nodes[a], nodes[b]) for a, b in links(sets, percent)] if len(nodes) > 1 else []


def _open(percent: int):
    def run(chunks: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        own, asked = chunks["node"].to_numpy(np.int64), queries["q_node"].to_numpy(np.int64)
        sets, asking = ([np.frombuffer(x, np.uint64) for x in c] for c in (chunks["shingles"], queries["q_shingles"]))
        found = []
        for mine, asks in _each(GROUP, chunks, queries):
            found += _opened(own[mine], [sets[i] for i in mine], asked[asks], [asking[i] for i in asks], percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


GROUP = ("grp", "chunk", "slice")


def _met(what: str, members: DataFrame, asking: DataFrame, facts: DataFrame, rows: int):
    """(chunks with their nodes cogrouped with slices of the nodes that ask them, groups of several chunks).

    members: (node, grp); asking: (node, grp) is sent to all chunks of the group; facts: node and the columns that both sides carry,
    of which ``what`` is bytes. Every chunk also has the group's centre, its least node, and is there once for each slice. A bin holds
    chunks of about CHUNK_BYTES, since most groups are small.
    """
    size = facts.agg(F.sum(F.length(what)).alias("n")).first()["n"] or 0
    bins = max(12, -(-4 * size // CHUNK_BYTES))
    bound = F.ceil(F.greatest(F.count("*") / rows, F.sum(F.length(what)) / CHUNK_BYTES)).cast("int")
    of_group = members.join(facts, "node")
    sizes = of_group.groupBy("grp").agg(bound.alias("chunks"), F.min("node").alias("centre"))
    queries = asking.join(facts, "node")
    slices = queries.groupBy("grp").agg(bound.alias("slices"))
    cut = sizes.join(slices, "grp", "left").select("grp", "chunks", "centre", F.coalesce("slices", F.lit(1)).alias("slices"))
    count = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    in_bin = lambda *of: F.pmod(F.xxhash64(*of), F.lit(bins)).cast("int")
    carried = [c for c in facts.columns if c != "node"]
    dealt = members.join(cut, "grp").select("grp", F.pmod(F.xxhash64("node"), "chunks").cast("int").alias("chunk"), "node", "slices")
    centres = cut.select("grp", count("chunks").alias("chunk"), F.col("centre").alias("node"), "slices")
    inside = dealt.union(centres).distinct().select("grp", "chunk", count("slices").alias("slice"), "node").join(facts, "node").withColumn("bin", in_bin(*GROUP))
    own_slice = queries.join(cut.drop("centre"), "grp").withColumn("q_slice", F.pmod(F.xxhash64("node", F.lit(1)), "slices").cast("int"))
    outside = own_slice.select(F.col("grp").alias("q_grp"), count("chunks").alias("q_chunk"), "q_slice", F.col("node").alias("q_node"), *(F.col(c).alias(f"q_{c}") for c in carried))
    outside = outside.withColumn("q_bin", in_bin(*(f"q_{c}" for c in GROUP)))
    return inside.groupBy("bin").cogroup(outside.groupBy("q_bin")), sizes.where("chunks > 1").select("grp", "centre")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, chunk: int = CHUNK, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id for each row; percent is 50 or more."""
    ensure_checkpoint_dir(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    with_id = texts.where("doc_id is not null").select("text")
    signs = with_id.mapInArrow(tidy(_signatures(shingle, percent)), "sign long, node long").repartition("sign")
    shared = signs.groupBy("sign").agg(F.min("node").alias("pivot"), F.max("node").alias("other")).where("pivot <> other").select("sign", "pivot")
    met = compact(signs.join(shared, "sign"))

    every = texts.mapInArrow(tidy(_nodes(table_of(met, "node"), shingle, percent)), "doc_id long, n_shingles long, node long, need int, bits binary").checkpoint()
    all_nodes = every.select("doc_id", "n_shingles", "node")
    own = compact(met.groupBy("node").agg(F.min("pivot").alias("grp")))
    rows = every.where("bits is not null").select("node", F.col("n_shingles").alias("size"), "bits", "need").dropDuplicates(["node"])

    # Of a sign's groups only its nodes' own ones count; signs of one group need no question.
    groups_of_sign = compact(met.select("sign", "node").join(own, "node").select("sign", "grp").distinct())
    many = groups_of_sign.groupBy("sign").agg(F.count("*").alias("groups")).where("groups > 1")
    hottest = Window.partitionBy("node").orderBy(F.desc("groups"), "sign")
    asked = met.select("sign", "node").join(many, "sign").withColumn("n", F.row_number().over(hottest)).join(rows.select("node", "need"), "node").where("n >= need").select("sign", "node")
    asks = compact(asked.join(groups_of_sign, "sign").select("node", "grp").distinct().join(own.toDF("node", "own"), "node").where("grp <> own").select("node", "grp"))

    # The matrix' rows leave the nodes that may have a partner; of large groups those that aren't near the centre meet all chunks.
    facts = compact(rows.select("node", "size", "bits"))
    groups, large = _met("bits", own, asks, facts, 8 * chunk)
    likely = compact(groups.applyInPandas(tidy_group(_sift(percent)), "node long").distinct())
    if large.limit(1).count():
        apart = own.join(large, "grp").join(likely, "node", "left_anti").select("node", "grp")
        likely = compact(likely.union(_met("bits", own, apart, facts, 8 * chunk)[0].applyInPandas(tidy_group(_sift(percent)), "node long")).distinct())

    # Their shingles are counted.
    sets = with_id.mapInArrow(tidy(_sets(table_of(likely, "node"), shingle)), "node long, shingles binary").dropDuplicates(["node"]).join(likely, "node").checkpoint()
    member = compact(own.join(sets.select("node"), "node").select("node", "grp"))
    groups, large = _met("shingles", member, asks.join(sets.select("node"), "node"), sets, chunk)
    edges = compact(groups.applyInPandas(tidy_group(_open(percent)), "a long, b long"))
    parts = connected_components(edges)
    if large.limit(1).count():
        centre = large.join(parts.toDF("centre", "main"), "centre", "left").select("grp", F.coalesce("main", "centre").alias("main"))
        label = member.join(parts, "node", "left").join(centre, "grp").where(F.coalesce("component", "node") != F.col("main"))
        more, _ = _met("shingles", member, label.select("node", "grp"), sets, chunk)
        parts = connected_components(compact(edges.union(more.applyInPandas(tidy_group(_open(percent)), "a long, b long"))))

    named = all_nodes.groupBy("node").agg(F.min("doc_id").alias("least")).where("node is not null and least is not null")
    whole = named.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = whole.join(smallest, "component").select("node", "component_id")
    found = all_nodes.join(of_node, "node", "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """Rows of docs whose id is the smallest of its component; rows without an id stay, and so do all rows of an id that stays.

    Only rows that a bit table of the ids to drop doesn't clear are joined with these ids, so texts that stay are hardly shuffled.
    """
    rest = near_duplicates(docs, percent, shingle=shingle).where("component_id <> doc_id").select("doc_id").distinct().checkpoint()
    may_go = marked(docs, "doc_id", table_of(rest, "doc_id"), "__tw_may")
    stays = may_go.where("not __tw_may").select(*docs.columns)
    return stays.unionByName(may_go.where("__tw_may").join(rest, "doc_id", "left_anti").select(*docs.columns))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents"), 90, shingle=3)


OP3_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT r, doc_id, array_to_string(w[i:i + 2], ' ') AS shingle FROM w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT r, doc_id, count(*) AS n FROM s GROUP BY ALL),
pairs AS (SELECT a.r AS a, b.r AS b, count(*) AS common_ FROM s a JOIN s b ON a.shingle = b.shingle AND a.r < b.r GROUP BY ALL),
links AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b FROM pairs JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * common_ >= 90 * (x.n + y.n - common_) AND x.doc_id <> y.doc_id),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, b AS other FROM both_ways UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON a = other),
least AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(other, w.doc_id)) AS component_id FROM w LEFT JOIN n USING (r) LEFT JOIN least ON least.doc_id = w.doc_id
"""
