"""N-gram Jaccard join: all documents whose sets of five-word shingles are alike to 0.8 or more.

Words are runs of letters, digits and other bytes above 127 of the lower-cased text; a text of one to four words is one
shingle, a text without words has none and links to nothing. Texts with equal sets are one node (they are alike to 1). MinHash
signatures of the nodes are banded: the number of bands is the least that reaches TARGET_RECALL at the threshold. Bands' hashes
are shuffled, nodes that share one are linked to the smallest of them, and the components of these links are the candidate groups:
any two nodes that share a band are in one group. Within a group all pairs are verified on their full shingle sets, in
blocks: groups larger than BLOCK nodes are cut into blocks, and each pair of blocks is a task of its own, so that no task
holds more than two blocks. Only link counts and each node's root within the block leave a task, never pairs.
A group so large that its nodes would be sent to more blocks than there are bands (chains of unlike texts make such groups in large corpora) is verified band by
band instead: nodes meet only those that share a band, each pair where it shares its first. Copies of one text, and a class's nodes, are dealt over several tasks by
`salted_join`.

Rows with a null id get a null class and no links. Rows that share an id take part one by one; their class is the smallest id of their own text's class.
Null and empty texts are of their own class. Texts of any length are compared by all of their shingles. Ties: the class is the smallest id. An empty table
gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import give_back, hot_keys, in_chunks, materialize, mix64, runs, salted_join, span_hashes, utf8
from tallyweave.llm.graph import components

WORDS, THRESHOLD, TARGET_RECALL, ROWS = 5, 0.8, 0.9999, 6
#: Nodes of a block.
BLOCK = 400
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """The least number of bands of `rows` minima with which a pair at the threshold shares a band with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def shingles(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its word n-grams."""
    data, ends = utf8([t.lower() if t else t for t in texts])
    begins, stops = runs(_WORD[data], ends[:-1])
    doc = np.searchsorted(ends, begins, side="right") - 1
    h = span_hashes(data, begins, stops)
    count = np.bincount(doc, minlength=len(texts))
    at = np.concatenate([[0], np.cumsum(count)])
    n = max(len(h) - words + 1, 0)
    gram = np.zeros(n, dtype=np.uint64)
    for k in range(words):
        gram = mix64(gram + h[k : k + n])
    out = []
    for i, c in enumerate(count.tolist()):
        if c >= words:
            out.append(np.unique(gram[at[i] : at[i] + c - words + 1]))
        elif c:
            whole = np.zeros(1, dtype=np.uint64)
            for x in h[at[i] : at[i] + c]:
                whole = mix64(whole + x)
            out.append(whole)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """bands hashes of each non-empty set; zeros for the empty."""
    out = np.zeros((len(sets), bands), dtype=np.uint64)
    some = [i for i, s in enumerate(sets) if len(s)]
    if some:
        flat = np.concatenate([sets[i] for i in some])
        first = np.cumsum([0] + [len(sets[i]) for i in some[:-1]])
        odd = mix64(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
        for b in range(bands):
            code = np.full(len(some), b + 1, dtype=np.uint64)
            for r in range(rows):
                code = mix64(code + np.minimum.reduceat(mix_with(flat, odd[b * rows + r]), first))
            out[some, b] = code
    return out


def mix_with(x: np.ndarray, odd: np.uint64) -> np.ndarray:
    """One of a family of permutations of 64-bit words."""
    y = x * odd
    return y ^ (y >> np.uint64(32))


def key_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b""


def signed(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """(id, key, bands) of every row; key is a digest of the shingle set, empty for none."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in in_chunks(texts, 1_000_000):
                sets = shingles(texts[a:b], words)
                sign = signatures(sets, bands, rows).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands * (b - a) + 1, bands), pa.int32()), pa.array(sign.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array([key_of(s) for s in sets], pa.binary()), lists], ["id", "key", "bands"])
        give_back()

    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, f"id {id_type}, key binary, bands array<long>")


def alike(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of `threshold` or more; exact, by products over the shared elements."""
    n, size = len(sets), np.array([len(s) for s in sets])
    common = np.zeros((n, n), dtype=np.float32)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.append(True, flat[1:] != flat[:-1])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    column = np.cumsum(np.append(True, column[1:] != column[:-1])) - 1 if len(column) else column
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
        some = slice(*np.searchsorted(column, [a, a + 8192]))
        m = np.zeros((n, 8192), dtype=np.float32)
        m[owner[some], column[some] - a] = 1
        common += m @ m.T
    union = size[:, None] + size[None, :] - common
    return (common >= threshold * union - 1e-6) & ~np.eye(n, dtype=bool) & (size[:, None] > 0) & (size[None, :] > 0)


def verify(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(key, links, root) of the nodes of two blocks: the documents they link to across the blocks (or within one), and the least key they are tied to.

    Of a unit that is the n-th band's, pairs that share an earlier band are left out: they meet there."""
    # Rows that share an id and a text come twice.
    rows = rows.drop_duplicates("key").sort_values("key").reset_index(drop=True)
    sets = [np.frombuffer(b, dtype=np.uint64) for b in rows["shingles"]]
    ok = alike(sets, threshold)
    if rows["i"].iloc[0] != rows["j"].iloc[0]:
        block = rows["block"].to_numpy()
        ok &= block[:, None] != block[None, :]
    nth = rows["nth"].iloc[0]
    if nth > 0:
        bands = np.stack(rows["bands"].to_list())
        for n in range(nth):
            ok &= bands[:, n, None] != bands[None, :, n]
    links = ok @ rows["n_docs"].to_numpy()
    root = np.arange(len(rows))
    while True:
        least = np.where(ok, root[None, :], len(rows)).min(1)
        new = np.minimum(root, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return pd.DataFrame({"key": rows["key"], "links": links.astype("int64"), "root": rows["key"].to_numpy()[root]})


def units(groups: DataFrame, nodes: DataFrame, block: int, large: int) -> DataFrame:
    """(key, id, n_docs, unit, nth, blocks, bands): where each node of the groups (node, root) is compared.

    A unit is a whole group (nth -1), or of a group of more than `large` nodes those that share the nth band."""
    sizes = materialize(groups.groupBy(F.col("root").alias("grp")).agg(F.count("*").alias("n")), "sizes")
    members = salted_join(groups.select(F.col("node").alias("key"), F.col("root").alias("grp")), sizes, "grp", hot_keys(sizes, "grp", "n"))
    members = materialize(members.join(nodes.hint("merge"), "key"), "members")
    blocks = lambda n: F.ceil(n / block).cast("int").alias("blocks")
    whole = members.where(F.col("n") <= large).select("key", "id", "n_docs", F.col("grp").alias("unit"), F.lit(-1).alias("nth"), blocks(F.col("n")), F.lit(None).cast("array<long>").alias("bands"))
    banded = members.where(F.col("n") > large).select("key", "id", "n_docs", "bands", F.posexplode("bands").alias("nth", "band"))
    banded = banded.withColumn("unit", F.unhex(F.concat(F.lpad(F.hex("nth"), 4, "0"), F.lpad(F.hex("band"), 16, "0")))).drop("band")
    shared = materialize(banded.groupBy("unit").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    met = salted_join(banded, shared, "unit", hot_keys(shared, "unit", "n"))
    return whole.unionByName(met.select("key", "id", "n_docs", "unit", "nth", blocks(F.col("n")), "bands"))


def join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = TARGET_RECALL, rows: int = ROWS, block: int = BLOCK, large: int | None = None
) -> DataFrame:
    """(id, class_id, n_links) of every row: the smallest id of its class of linked documents, and how many documents it links to.

    block: nodes of a block; large: nodes from which on a group is verified band by band (block * bands). Neither changes the result."""
    bands = bands_for(threshold, recall, rows)
    id_type = docs.schema[id_col].dataType.simpleString()
    sign = materialize(signed(docs, id_col, text_col, words, bands, rows), "signatures")
    named = sign.where("id IS NOT NULL AND octet_length(key) > 0")
    nodes = materialize(named.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n_docs"), F.first("bands").alias("bands")), "nodes")
    banded = nodes.select("key", F.explode("bands").alias("band"))
    hubs = materialize(banded.groupBy("band").agg(F.min("key").alias("hub"), F.max("key").alias("last")).where("hub < last").select("band", "hub"), "hubs")
    starred = banded.join(hubs.hint("merge"), "band")  # a hot band is the skewed side of a plain join, which Spark splits
    groups = components(starred.where("key <> hub").select(F.col("key").alias("a"), F.col("hub").alias("b")))
    members = materialize(units(groups, nodes, block, large or block * bands), "units")
    verified = materialize(verified_links(docs, members, id_col, text_col, words, threshold), "verified")
    classes = components(verified.where("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")))
    class_ids = materialize(classes.join(nodes.select(F.col("key").alias("node"), "id").hint("merge"), "node").groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("n")), "classes")
    of_node = salted_join(classes, class_ids.drop("n"), "root", hot_keys(class_ids, "root", "n")).select(F.col("node").alias("key"), "class_id")
    links = verified.groupBy("key").agg(F.sum("links").alias("links"))
    known = nodes.select("key", "n_docs", "id").join(of_node, "key", "left").join(links, "key", "left")
    known = materialize(known.select("key", "n_docs", F.coalesce("class_id", "id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links")), "known")
    keyed = sign.select("id", F.when(F.col("id").isNotNull(), F.col("key")).alias("key"))
    found = salted_join(keyed, known.drop("n_docs"), "key", hot_keys(known, "key", "n_docs"), "left")
    return found.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").cast(id_type).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def verified_links(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, words: int, threshold: float) -> DataFrame:
    """(key, links, root) of the nodes of `units` for each pair of blocks that they stand in."""
    # Both sides grow with the input: neither is ever broadcast. A node's units share the one row of its text.
    where = members.groupBy("key").agg(F.first("id").alias("id"), F.first("n_docs").alias("n_docs"), F.first("bands").alias("bands"), F.collect_list(F.struct("unit", "nth", "blocks")).alias("units"))
    texts = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").join(where.hint("merge"), "id")
    names = ["key", "n_docs", "bands", "units"]

    def run(batches):
        for batch in batches:
            texts, keys = batch.column("text").to_pylist(), batch.column("key").to_pylist()
            for a, b in in_chunks(texts, 1_000_000):
                sets = shingles(texts[a:b], words)
                mine = [i for i in range(a, b) if key_of(sets[i - a]) == keys[i]]
                rows = batch.take(pa.array(mine, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), pa.array([sets[i - a].tobytes() for i in mine], pa.binary())], [*names, "shingles"])
        give_back()

    unit_type = "array<struct<unit: binary, nth: int, blocks: int>>"
    sets = texts.mapInArrow(run, f"key binary, n_docs long, bands array<long>, units {unit_type}, shingles binary").withColumn("u", F.explode("units"))
    placed = sets.select("key", "n_docs", "bands", "shingles", "u.*").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = other.select("unit", "nth", "key", "n_docs", "bands", "shingles", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return pairs.groupBy("unit", "i", "j").applyInPandas(lambda rows: verify(rows, threshold), "key binary, links long, root binary")
