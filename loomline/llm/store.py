"""A content-addressed store of token ids: rolling-hash chunks, recipes, Merkle manifests."""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomline.llm.scratch import durable, in_order, running_total
from loomline.llm.textblocks import U64, blocks, mix, utf8
from loomline.llm.tokens import byte_letters

MAX_PIECES = 350_000
ENCODED = 4_000_000  # bytes of text whose ids a worker gathers at a time
WINDOW, AVERAGE_BITS, SHORTEST, LONGEST = 32, 9, 64, 4096  # of a chunk, in ids
#: White space of Python that the tokenizer does not split at.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Latin letters and below, where lower-casing is one to one and every text is in normal form C.
NOT_LATIN = re.compile("[^\x00-\u012f\u0131-\u024f]")
#: The pre-tokenizer's pattern (fixed value).
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class Encoder:
    """Ids of whole texts by the tokenizers library, asked once for each distinct word.

    For a vocabulary that drops white space, pieces between white space encode independently, so
    a text's ids are its pieces' ids in a row. Pieces are kept in two generations of MAX_PIECES at most and a block's. Latin pieces are cut into words here and
    the library's model encodes each new word; other pieces go through all of the library's
    steps. Texts that hold special strings or ASCII separators go to the library whole.
    """

    def __init__(self, path: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # every word is asked once; the library's own cache only costs time
        self.tokenize = self.model.tokenize
        self.letters = {b: c for c, b in byte_letters().items()}
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.end = np.array([end_id], self.kind).tobytes()
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        """Ids of one lower-cased word by the library's model."""
        raw = self.known.get(word) or self.older.get(word)  # a word alone is also a piece with the same ids
        if raw is None:
            as_letters = word if word.isascii() and word.isprintable() else word.encode("utf-8").decode("latin-1").translate(self.letters)
            raw = array(self.code, [t.id for t in self.tokenize(as_letters)]).tobytes()
        self.known[word] = raw
        return raw

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece of Latin letters and below."""
        low = piece.lower()
        if low.isalpha():
            return self._word(low)
        if low[-1] in ".,!" and low[:-1].isalpha():
            return self._word(low[:-1]) + self._word(low[-1])
        return b"".join(map(self._word, WORD.findall(low)))

    def _learn(self, new: list[str]) -> None:
        """Make different pieces known that no white space of any kind splits."""
        other = [p for p in new if not p.isascii() and NOT_LATIN.search(p)]
        if other:
            self.known.update(zip(other, self._library(other), strict=True))
            new = set(new).difference(other)
        self.known.update((p, self._piece(p)) for p in new)

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces between ASCII white space; what the two generations of known pieces do not hold is learned."""
        if len(self.known) > MAX_PIECES:
            self.older, self.known = self.known, {"": b""}
        raw = list(map(self.known.get, pieces))
        missing = [i for i, r in enumerate(raw) if r is None]
        new = []
        for i in missing:
            old = raw[i] = self.older.get(pieces[i])
            if old is None:
                new.append(i)
            else:
                self.known[pieces[i]] = old
        parts = {i: p for i in new if not (w := pieces[i]).isascii() and (p := w.split()) != [w]}  # other white space stands inside
        inner = {w for p in parts.values() for w in p if w not in self.known}
        self._learn(list(inner.union(pieces[i] for i in new if i not in parts)) if parts else [pieces[i] for i in new])
        self.known.update((pieces[i], b"".join(map(self.known.__getitem__, p))) for i, p in parts.items())
        for i in new:
            raw[i] = self.known[pieces[i]]
        return raw

    def block(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, with the end id.

        Arrow splits the texts at ASCII white space and numbers the different pieces; their ids are laid end to end once and gathered by number.
        """
        whole = {i for i, t in enumerate(texts) if SEPARATORS.search(t) or self.special and "<" in t and self.special.search(t)}
        lists = pc.ascii_split_whitespace(pa.array(["" if i in whole else _folded(t) for i, t in enumerate(texts)], pa.large_string()))
        coded = lists.values.dictionary_encode()
        raw = [*self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), self.end]
        table = np.frombuffer(b"".join(raw), self.kind)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // self.kind.itemsize
        starts = np.cumsum(sizes) - sizes
        bounds = lists.offsets.to_numpy()[1:]
        piece = np.insert(coded.indices.to_numpy(), bounds, len(raw) - 1)
        n = sizes[piece]
        till = np.cumsum(n)
        ids = table[np.repeat(starts[piece] - till + n, n) + np.arange(till[-1])]
        out = np.split(ids, till[bounds + np.arange(len(bounds))][:-1])
        for i in whole:
            out[i] = np.frombuffer(self._library([texts[i]])[0] + self.end, self.kind)
        return out


def _folded(text: str) -> str:
    """A Latin-1 text in lower case, as the library would make it, so fewer pieces differ; others as they are."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> Encoder:
    return Encoder(path, end_id)


def cut_ids(docs: list[np.ndarray]) -> list[list[int]]:
    """Ends of each document's chunks: places where a rolling hash of the last ids has its top bits zero.

    Cuts depend on the ids near them only, so an edit changes the chunks it touches and equal
    stretches of different documents share chunks.
    """
    ids = np.concatenate(docs).astype(U64)
    with np.errstate(over="ignore"):
        h = mix(ids + U64(77))
        w = 1
        while w < WINDOW:
            h[w:] = h[w:] + (h[:-w] << U64(w))
            w *= 2
    marks = np.flatnonzero(h >> U64(64 - AVERAGE_BITS) == 0) + 1
    ends, at = [], 0
    for d in docs:
        lo, hi = np.searchsorted(marks, [at, at + len(d)])
        cuts, last = [], 0
        for m in (marks[lo:hi] - at).tolist():
            while m - last > LONGEST:
                last += LONGEST
                cuts.append(last)
            if m - last >= SHORTEST:
                cuts.append(m)
                last = m
        while len(d) - last > LONGEST:
            last += LONGEST
            cuts.append(last)
        if last < len(d):
            cuts.append(len(d))
        ends.append(cuts)
        at += len(d)
    return ends


def merkle_root(leaves: list[bytes]) -> bytes:
    """The root of a binary Merkle tree; an odd node moves up unchanged."""
    level = leaves or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


OBJECT = "kind int, key binary, id long, n long, data binary, cuts binary, root binary"


def _objects(path: str, end_id: int):
    """Chunks (kind 0, by content) and recipes (kind 1, one for each row) of a table (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sent, row, task = encoder(path, end_id), set(), 0, TaskContext.get().partitionId()
        for batch in batches:
            data, off = utf8(batch.column(1))
            keys = batch.column(0).to_pylist()
            for lo, hi in blocks(off, ENCODED):
                raw = data[off[lo] : off[hi]].tobytes()
                texts = [raw[off[i] - off[lo] : off[i + 1] - off[lo]].decode("utf-8", "replace") for i in range(lo, hi)]
                docs, out = encode.block(texts), []
                for i, ids, ends in zip(range(lo, hi), docs, cut_ids(docs), strict=True):
                    shas, start = [], 0
                    for end in ends:
                        chunk = ids[start:end].tobytes()
                        sha = hashlib.sha256(chunk).digest()
                        shas.append(sha)
                        if sha not in sent:
                            if len(sent) > 500_000:
                                sent.clear()
                            sent.add(sha)
                            out.append((0, sha, None, end - start, chunk, None, None))
                        start = end
                    mark = task.to_bytes(4, "big") + row.to_bytes(8, "big")
                    out.append((1, mark, keys[i], len(ids), b"".join(shas), np.array(ends, "<u4").tobytes(), merkle_root(shas)))
                    row += 1
                kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in OBJECT.split(", ")])

    return run


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every text of ``docs``, each with ``end_id`` appended, as a store at ``path``.

    ``objects/kind=0``: unique chunks (key: SHA-256 of data, little-endian ids of 2 bytes, or 4 for
    a vocabulary over 65,536). One shuffle by key, with copies dropped before it where a task has
    seen them, keeps one of each. ``recipes``: in ascending id order, null ids first, each row's
    start (ids of all rows before it), n_tokens, chunk keys, chunk ends and Merkle root.
    ``manifest``: a digest of each run of 1,024 recipes of a tile (a range of ids), of each tile, and of all.
    ``head``: the width of an id in bytes, and the end id.

    Null and empty texts are the end id alone; repeated rows each have a recipe; an empty table
    gives an empty store; other columns are ignored.
    """
    spark = docs.sparkSession
    table = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    found = table.mapInArrow(_objects(tokenizer, end_id), OBJECT).groupBy("kind", "key").agg(*(F.first(c).alias(c) for c in ("id", "n", "data", "cuts", "root")))
    found.write.partitionBy("kind").parquet(f"{path}/objects")
    made = spark.read.schema(OBJECT).parquet(f"{path}/objects")
    rows = made.where("kind = 1").select("id", "n", F.col("data").alias("shas"), "cuts", "root", "key")
    tiles = running_total(in_order(rows, [F.col("id"), F.col("key")], "store-order"), "n", "start")
    recipes = tiles.select("tile", "tile_row", "pos", "id", "start", F.col("n").alias("n_tokens"), "shas", "cuts", "root")
    recipes.repartitionByRange("pos").sortWithinPartitions("pos").write.parquet(f"{path}/recipes")
    digests = _runs(spark.read.schema(RECIPE).parquet(f"{path}/recipes"))
    for level, over, by in LEVELS:
        digests = digests if level == "run" else _above(digests, over, by)
        digests.write.parquet(f"{path}/manifest/level={level}")
        digests = _written(spark, path, level, digests.schema)
    head = spark.createDataFrame([(encoder(tokenizer, end_id).kind.itemsize, end_id)], "width int, end_id int")
    head.coalesce(1).write.parquet(f"{path}/head")


RECIPE = "tile int, tile_row long, pos long, id long, start long, n_tokens long, shas binary, cuts binary, root binary"
LEVELS = (("run", ["tile", "run"], "tile_row"), ("tile", ["tile"], "run"), ("all", [], "tile"))


def _above(digests: DataFrame, over: list[str], by: str) -> DataFrame:
    """The digests of groups of digests, in the order of ``by``."""
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(by, "mark"))), lambda x: x["mark"]))
    return digests.groupBy(*over).agg(F.sha2(joined, 256).alias("mark"))


def _runs(recipes: DataFrame) -> DataFrame:
    """The manifest's lowest level: digests of runs of 1,024 recipes of a tile. A leaf covers a recipe's place, id, start, length, chunk ends and root."""
    leaf = F.sha2(F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("pos", "id", "start", "n_tokens")), F.hex("cuts"), F.hex("root")), 256)
    return _above(recipes.select("tile", F.floor(F.col("tile_row") / 1024).alias("run"), "tile_row", leaf.alias("mark")), *LEVELS[0][1:])


def _written(spark: SparkSession, path: str, level: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/manifest/level={level}")


def verify_manifest(spark: SparkSession, path: str) -> None:
    """Compare every digest of a store's manifest with the recipes found; a lost, added or changed recipe is an error."""
    digests = durable(_runs(spark.read.schema(RECIPE).parquet(f"{path}/recipes")), "store-runs")
    for level, over, by in LEVELS:
        digests = digests if level == "run" else _above(digests, over, by)
        sides = _written(spark, path, level, digests.schema).withColumn("side", F.lit(1)).unionByName(digests.withColumn("side", F.lit(-1)))
        off = sides.groupBy(*digests.columns).agg(F.sum("side").alias("side")).where("side <> 0").take(1)
        if off:
            raise ValueError(f"the recipes of {path} do not match its manifest: level {level}, {off[0]}")


def _check(kind: str):
    """Chunks (key, data) -> key, ids, CRC-32 of the ids as 4-byte words; a chunk that does not hash to its key is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, datas = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, d in zip(keys, datas, strict=True):
                if hashlib.sha256(d).digest() != k:
                    raise ValueError(f"chunk {k.hex()} does not match its key")
            ids = [np.frombuffer(d, kind) for d in datas]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())],
                ["key", "ids", "crc"],
            )

    return run


CRC_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """The product of two polynomials over GF(2), bit-reversed, modulo the CRC-32 polynomial."""
    product = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            product ^= b
        b = b >> 1 ^ (CRC_POLYNOMIAL if b & 1 else 0)
    return product


@lru_cache(maxsize=20_000)
def _shift(n_bytes: int) -> int:
    """x to the power of 8 x ``n_bytes``, modulo the CRC-32 polynomial."""
    power, square, n = 1 << 31, 1 << 30, 8 * n_bytes
    while n:
        if n & 1:
            power = _times(power, square)
        square, n = _times(square, square), n >> 1
    return power


def crc_of_parts(parts: list[tuple[int, int]]) -> int:
    """The CRC-32 of a concatenation, from each part's CRC-32 and number of bytes."""
    crc = 0
    for part, n_bytes in parts:
        crc = (_times(_shift(n_bytes), crc) if crc else 0) ^ part
    return crc


def _join_crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crcs = []
        for n, want, root, parts in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
            parts = sorted(parts, key=lambda p: p["seq"])
            if any(p["crc"] is None for p in parts):
                raise ValueError("a chunk is missing")
            if len(parts) != want or merkle_root([p["key"] for p in parts]) != root or sum(p["ids"] for p in parts) != n:
                raise ValueError("a recipe does not match its chunks")
            crcs.append(crc_of_parts([(p["crc"], 4 * p["ids"]) for p in parts]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crcs, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])


def _parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The verified recipes' chunk keys, one row each, and the chunks."""
    verify_manifest(spark, path)
    recipes = spark.read.schema(RECIPE).parquet(f"{path}/recipes")
    recipes = recipes.select("pos", "id", "start", "n_tokens", "root", "shas", (F.octet_length("shas") / 32).cast("int").alias("want"))
    pieces = recipes.select("pos", "id", "start", "n_tokens", "root", "want", F.explode(F.sequence(F.lit(0), F.col("want") - 1)).alias("seq"), "shas")
    pieces = pieces.withColumn("key", F.substring(F.col("shas"), F.col("seq") * 32 + 1, F.lit(32))).drop("shas")
    return pieces, spark.read.schema(OBJECT).parquet(f"{path}/objects").where("kind = 0").select("key", "data")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Read a store back: id, start, n_tokens and ids_crc32 (CRC-32 of the ids as little-endian 4-byte words).

    The recipes are first checked against all levels of the manifest. Every chunk is read once and checked against its
    key; only its CRC goes on, and each document's is put together from its recipe and checked against its Merkle
    root and length. A lost or changed recipe or chunk is an error.
    """
    width = spark.read.parquet(f"{path}/head").first().width
    pieces, chunks = _parts(spark, path)
    checked = chunks.mapInArrow(_check(f"<u{width}"), "key binary, ids long, crc long")
    whole = pieces.join(checked, "key", "left").groupBy("pos").agg(
        *(F.first(c).alias(c) for c in ("id", "start", "n_tokens", "want", "root")), F.collect_list(F.struct("seq", "key", "ids", "crc")).alias("parts")
    )
    return whole.drop("pos").mapInArrow(_join_crcs, "id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Read a store back: pos, id, start, n_tokens and ids (the bytes of all its ids in a row); a lost recipe or chunk is an error."""
    pieces, chunks = _parts(spark, path)
    data = F.coalesce("data", F.raise_error(F.lit("a chunk is missing")).cast("binary"))
    parts = F.array_sort(F.collect_list(F.struct("seq", data.alias("data"))))
    whole = pieces.join(chunks, "key", "left").groupBy("pos", "id", "start", "n_tokens").agg(parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["data"]))
    return whole.select("pos", "id", "start", "n_tokens", joined.alias("ids"))
