"""Near-duplicate documents: a Jaccard join over word shingles with a count-vector R-tree.

1. Chunks hash their shingles and ask the buckets of the hashes which of them other texts have. A set
   with a similar partner shares the asked percentage of its shingles, so most sets rest here.
2. The sets left meet in blocks by a smallest hash. A block is an R-tree over count vectors; its pairs
   are verified, but only until the block hangs together.
3. What is not connected then meets once more by each hash of its prefix, of which similar sets share
   one. Prefixes hold the rarest shingles: buckets answer in how many chunks a shingle is. Pairs of
   different components that pass the bound of the tree are verified too.

Equal sets count as one. Blocks are split by size, and a group of many gives a tree of links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage
from .anchors import mixed
from .chunks import (
    bits_of, buckets_for, chunk_bytes_of, codes_of, per_chunk, rest_of, sent_widths, widths_elsewhere,
    write_chunks,
)
from .components import component_roots
from .count_tree import candidates, count_vector, groups_for, needed, packed, pair_bounds, unpacked
from .words import LOWER, word_borders, word_hashes

SHINGLE, PERCENT = 5, 75
#: Rounds of blocks by a smallest hash, sets of a block, and sets of a unit that needs no tree.
ROUNDS, BLOCK, SMALL = 2, 512, 48
#: Rows of prefix hashes, and bytes of vectors at most, that one group looks at together.
TASK_ROWS, TASK_BYTES = 32_768, 64 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(chunk: dict, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document of each shingle, its hash, set sizes): distinct shingles, sorted within a document."""
    data, sizes = chunk_bytes_of(chunk)
    data = LOWER[data]
    begin, end, counts = word_borders(data, sizes)
    words = word_hashes(data, begin, end)
    owner = np.repeat(np.arange(len(sizes)), counts)
    with np.errstate(over="ignore"):
        many = max(len(words) - length + 1, 0)
        value = np.zeros(many, np.uint64)
        for k in range(length):
            value = mixed(value * ODD + words[k:k + many])
        whole = np.flatnonzero(owner[:many] == owner[len(words) - many:]) if many else np.empty(0, np.int64)
        hashes, docs = [value[whole]], [owner[whole]]
        heads = np.cumsum(counts) - counts
        short = np.flatnonzero((counts > 0) & (counts < length))
        if len(short):  # fewer words: the whole sequence is one shingle
            own = mixed(np.zeros(len(short), np.uint64) + counts[short].astype(np.uint64))
            for k in range(length - 1):
                more = counts[short] > k
                own[more] = mixed(own[more] * ODD + words[heads[short[more]] + k])
            hashes.append(own)
            docs.append(short)
    value, doc = np.concatenate(hashes), np.concatenate(docs)
    rows = np.lexsort((value, doc))
    value, doc = value[rows], doc[rows]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], value[new], np.bincount(doc[new], minlength=len(sizes))


def _names(value: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each set that tell sets apart."""
    if not len(size):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    heads = np.append(0, np.cumsum(size))
    out = []
    with np.errstate(over="ignore"):
        for salt in (ODD, ODD * np.uint64(3)):
            sums = np.append(np.uint64(0), np.cumsum(mixed(value ^ salt)))
            out.append((sums[heads[1:]] - sums[heads[:-1]]).view(np.int64))
    return out[0], out[1]


def _array(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint64)


def similar(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted hashes."""
    at = np.minimum(np.searchsorted(right, left), len(right) - 1)
    both = int((right[at] == left).sum())
    return 100 * both >= percent * (len(left) + len(right) - both)


def block_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between the sets of a block that hang together all that are similar, at most one less."""
    sizes = np.array([len(s) for s in sets])
    vectors = [count_vector(s, groups_for(len(s))) for s in sets]
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    found = []
    for i, near in candidates(vectors, sizes, percent):
        for j in near[near < i].tolist():
            a, b = root(i), root(j)
            if a != b and similar(sets[i], sets[j], percent):
                parent[max(a, b)] = min(a, b)
                found.append((i, j))
    return found


def _edges(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({n: pa.array([p[i] for p in pairs], pa.int64()) for i, n in enumerate("ab")})


def _blocks(sets: DataFrame, percent: int) -> DataFrame:
    """Links found in blocks of sets that share their smallest hash, in ``ROUNDS`` orders of hashes."""

    def slots(batches):
        for batch in batches:
            rows = []
            for node, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = _array(blob)
                with np.errstate(over="ignore"):
                    for r in range(ROUNDS):
                        salt = np.uint64(r) * ODD
                        rows.append((node, int((mixed(own ^ salt).min() + np.uint64(r)).view(np.int64))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["node", "slot"]
            )

    placed = cut_lineage(sets.select("node", "shingles").mapInArrow(slots, "node bigint, slot bigint"), "slots")
    many = placed.groupBy("slot").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    parts = F.ceil(F.col("many") / BLOCK)
    placed = placed.join(many, "slot").select(
        "node", "slot", F.pmod(F.xxhash64("node", "slot"), parts).alias("part")
    )
    full = placed.join(sets, "node").select("slot", "part", "node", "shingles")

    def link(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_pylist()
        found = block_links([_array(b) for b in table.column("shingles").to_pylist()], percent)
        return _edges([(nodes[i], nodes[j]) for i, j in found])

    return full.groupBy("slot", "part").applyInArrow(link, "a bigint, b bigint")


def prefixes_of(doc: np.ndarray, value: np.ndarray, rank: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of those of each set's rarest shingles that others have.

    ``value`` is sorted within ``doc``. ``rank`` depends on the shingle only, up to 1 if one set has it.
    Of two similar sets, the first n - ceil(n * percent / 100) + 1 shingles in this order share one.
    """
    order = np.lexsort((rank, doc))
    doc, value, rank = doc[order], value[order], rank[order]
    size = np.bincount(doc)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    held = (place <= (size + -size * percent // 100)[doc]) & (rank > 1)
    return doc[held], value[held]


def unit_pairs(units: pa.Table, points: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Pairs of nodes of different components that share a unit and whose bound allows a link, once each.

    A unit is a hash with two parts of the sets that have it; the rows hold several units. ``points``
    has the count vector of each set once.
    """
    token, i, j, part, node = (np.array(units.column(c)) for c in ("token", "i", "j", "part", "node"))
    names, root, size = (np.array(points.column(c)) for c in ("node", "root", "size"))
    by_name = np.argsort(names)
    names, root, size = names[by_name], root[by_name], size[by_name]
    blobs = points.column("counts")
    vectors = [unpacked(blobs[k].as_py(), int(n)) for k, n in zip(by_name.tolist(), size.tolist())]
    row = np.searchsorted(names, node)
    order = np.lexsort((j, i, token))
    edge = np.flatnonzero(
        (np.diff(token[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)
    ) + 1
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for rows in np.split(order, edge) if len(order) else []:
        own, at = row[rows], part[rows]
        if (root[own] == root[own[0]]).all():
            continue
        if len(own) <= SMALL:
            a, b = np.triu_indices(len(own), 1)
        else:
            pairs = [(k, f) for k, found in candidates([vectors[r] for r in own.tolist()], size[own], percent)
                     for f in found[found > k].tolist()]
            a, b = np.array(pairs, np.int64).reshape(-1, 2).T
        apart = root[own[a]] != root[own[b]]
        if i[rows[0]] != j[rows[0]]:
            apart &= at[a] != at[b]
        a, b = own[a[apart]], own[b[apart]]
        left.append(np.minimum(a, b))
        right.append(np.maximum(a, b))
    left, right = np.divmod(np.unique(np.concatenate(left) * len(names) + np.concatenate(right)), max(len(names), 1))
    low, high = np.minimum(size[left], size[right]), np.maximum(size[left], size[right])
    may = 100 * low >= percent * high
    left, right = left[may], right[may]
    may = pair_bounds(vectors, left, right) >= needed(size[left], size[right], percent)
    return list(zip(names[left[may]].tolist(), names[right[may]].tolist()))


def _across(sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Links between sets that share a hash of their prefix but are in different components."""
    known = sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def tokens_of(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                own = [_array(b) for b in part.column("prefix").to_pylist()]
                many = [len(p) for p in own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(own).view(np.int64)),
                     *(pa.array(np.repeat(np.array(part.column(c)), many)) for c in ("node", "root", "size"))],
                    names=["token", "node", "root", "size"],
                )

    tokens = cut_lineage(
        known.select("node", "root", "size", "prefix")
        .mapInArrow(tokens_of, "token bigint, node bigint, root bigint, size bigint"), "tokens"
    )
    parts = F.ceil(F.col("many") / BLOCK).cast("int")
    mixed_tokens = cut_lineage(
        tokens.groupBy("token").agg(
            F.count(F.lit(1)).alias("many"), F.min("root").alias("low"), F.max("root").alias("high"),
            F.sum("size").alias("weight"),
        ).filter("low < high").select("token", "low", parts.alias("parts"), "many", "weight"),
        "mixed",
    )
    # hashes with the same smallest component mostly hold the same pairs, so they go to one group; a
    # component that comes with very many of them to several. These are few: one for TASK_ROWS rows or
    # TASK_BYTES at most
    shares = cut_lineage(
        mixed_tokens.groupBy("low").agg(F.greatest(
            F.ceil(F.sum(F.col("many") * F.col("parts")) / TASK_ROWS),
            F.ceil(F.sum(2 * F.col("weight") * F.col("parts")) / TASK_BYTES),
        ).alias("shares")).filter("shares > 1"),
        "shares",
    )
    dealt = mixed_tokens.join(shares, "low", "left").select(
        "token", "low", "parts", F.coalesce("shares", F.lit(1)).alias("shares")
    )
    spread = tokens.join(dealt, "token").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    # every two parts of a large group meet once
    units = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "low", "shares", "token", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node"
    )
    units = cut_lineage(
        units.withColumn("share", F.pmod(F.xxhash64("token", "i", "j"), "shares")).drop("shares"), "units"
    )

    def vectors(batches):
        for batch in batches:
            sets = [_array(b) for b in batch.column("shingles").to_pylist()]
            counts = pa.array([packed(count_vector(s, groups_for(len(s)))) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("root"), batch.column("size"), counts],
                names=["node", "root", "size", "counts"],
            )

    places = units.select(F.col("low").alias("at"), F.col("share").alias("at_share"), F.col("node").alias("name")).distinct()
    points = known.join(places, known["node"] == places["name"], "left_semi").select("node", "root", "size", "shingles")
    points = points.mapInArrow(vectors, "node bigint, root bigint, size bigint, counts binary")
    met = places.join(points, F.col("name") == F.col("node")).drop("name").groupBy("at", "at_share")

    def near(units: pa.Table, points: pa.Table) -> pa.Table:
        return _edges(unit_pairs(units, points, percent))

    pairs = units.groupBy("low", "share").cogroup(met).applyInArrow(near, "a bigint, b bigint").distinct()
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))

    def verify(batches):
        for batch in batches:
            keep = [
                similar(_array(x), _array(y), percent)
                for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(verify, "a bigint, b bigint")


def similar_rows(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
    percent: int = PERCENT, chunks: DataFrame | None = None, **options,
) -> DataFrame:
    """One row per input row: row, doc_id, n_shingles, component_id, leader.

    Texts are similar if their sets of distinct shingles of ``shingle`` lower-cased words have a
    Jaccard similarity of at least ``percent`` percent; a shorter text has its word sequence as its
    one shingle. Null texts and texts without words have no shingles and link with nothing.
    ``component_id`` is the smallest id reachable over links, null ids last. ``leader`` is true for
    one row of each component, the first with that id. Ids may repeat; an empty table gives no rows.
    ``chunks`` are the documents as ``write_chunks`` packed them, if that is done.
    """
    chunks = chunks if chunks is not None else write_chunks(documents, id_col=id_col, text_col=text_col, **options)
    count = buckets_for(chunks)
    plain = chunks.select("chunk", "ids", "sizes", "data")

    def codes(chunk: dict) -> np.ndarray:
        return np.unique(codes_of(mixed(shingle_sets(chunk, shingle)[1]), count))

    def describe(chunk: dict, sent: list[bytes]) -> pa.Table:
        with np.errstate(over="ignore"):
            doc, value, size = shingle_sets(chunk, shingle)
            s1, s2 = _names(value, size)
            first = np.zeros(len(size), bool)  # of equal sets in the chunk
            first[np.unique(np.stack([s1, s2, size]), axis=1, return_index=True)[1]] = True
            code = codes_of(mixed(value), count)
        names, inverse = np.unique(code, return_inverse=True)
        own = first[doc]
        width, local = sent_widths(names, sent), np.bincount(inverse[own], minlength=len(names))
        rank = np.where(width > 0, width, bits_of(local))[inverse]
        hits = np.bincount(doc[own & (rank > 1)], minlength=len(size))
        may = first & (size > 0) & (100 * hits >= percent * size)
        held = np.flatnonzero(may[doc])
        owner, rare = prefixes_of(doc[held], value[held], rank[held], percent)
        many = np.bincount(owner, minlength=len(size))
        may &= many > 0
        base = ((chunk["chunk"] >> 32) << 40) | ((chunk["chunk"] & 0xFFFFFFFF) << 18)

        def blobs(values: np.ndarray, counts: np.ndarray) -> pa.Array:
            heads = np.cumsum(counts) - counts
            return pa.array([
                values[h:h + n].tobytes() if m else None for h, n, m in zip(heads.tolist(), counts.tolist(), may.tolist())
            ], pa.binary())

        return pa.table({
            "row": pa.array(base + np.arange(len(size))), "doc_id": pa.array(chunk["ids"], pa.int64()),
            "size": pa.array(size), "s1": pa.array(s1), "s2": pa.array(s2),
            "shingles": blobs(value, size), "prefix": blobs(rare, many),
        })

    rows = cut_lineage(
        per_chunk(plain, widths_elsewhere(plain, codes), describe,
                  "row bigint, doc_id bigint, size bigint, s1 bigint, s2 bigint, shingles binary, prefix binary"),
        "sets",
    )
    classes = cut_lineage(
        rows.filter("size > 0").groupBy("s1", "s2", "size").agg(F.min("row").alias("node"), F.min("doc_id").alias("least")),
        "classes",
    )
    sets = rows.filter("shingles IS NOT NULL").select(F.col("row").alias("node"), "size", "shingles", "prefix").join(
        classes.select("node"), "node", "left_semi"
    )
    links = cut_lineage(_blocks(sets, percent), "links")
    roots = component_roots(links)
    more = cut_lineage(_across(sets, roots, percent), "links")
    if not more.isEmpty():
        roots = component_roots(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))

    known = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(least, "root").select("s1", "s2", "size", "root", "component_id")
    narrow = rows.select("row", "doc_id", "size", "s1", "s2")
    linked = narrow.filter("size > 0").join(known, ["s1", "s2", "size"])
    first = linked.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("row").alias("lead"))
    linked = linked.join(first, "root").select(
        "row", "doc_id", F.col("size").alias("n_shingles"), "component_id", (F.col("row") == F.col("lead")).alias("leader")
    )
    alone = narrow.filter("size = 0").select(
        "row", "doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("leader")
    )
    return linked.unionByName(alone)


def without_similar(documents: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The documents with one row of each component left, columns as given; rows without words all stay."""
    chunks = write_chunks(documents, keep=True, text_col=text_col, **{k: options[k] for k in ("id_col",) if k in options})
    gone = similar_rows(documents, text_col=text_col, chunks=chunks, **options).filter("NOT leader")
    chunk = F.expr("((row >> 40) << 32) | ((row >> 18) & 4194303)")
    letters = gone.select(chunk.alias("chunk"), F.expr("row & 262143").alias("place")).groupBy("chunk").agg(
        F.collect_list("place").alias("payload")  # at most the rows of a chunk
    )
    others = [f for f in documents.schema.fields if f.name != text_col]
    rest = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in others)

    def stay(chunk: dict, sent: list[list[int]]) -> pa.Table:
        data, sizes = chunk_bytes_of(chunk)
        raw, ends = data.tobytes(), np.cumsum(sizes)
        keep = np.ones(len(sizes), bool)
        for places in sent:
            keep[places] = False
        texts = [
            None if chunk["sizes"][i] < 0 else raw[ends[i] - sizes[i]:ends[i]].decode("utf-8", "surrogatepass")
            for i in np.flatnonzero(keep).tolist()
        ]
        kept = rest_of(chunk["rest"]).combine_chunks().filter(pa.array(keep))
        return pa.table({"_text": pa.array(texts, pa.string()), "_rest": kept})

    left = per_chunk(chunks, letters, stay, f"_text string, _rest struct<{rest}>")
    return left.select(*[
        F.col("_text").alias(c) if c == text_col else F.col("_rest")[c].alias(c) for c in documents.columns
    ])


SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS s
  FROM texts
), shingles AS (
  SELECT doc_id, len(s) AS n, md5_number(unnest(s)) AS h FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id <> b.doc_id AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, len(s)
"""
