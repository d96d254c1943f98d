"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents become pieces of at most ``capacity`` tokens.  Packing is hierarchical: every partition packs its
own pieces by best fit (longest first, into the open sequence with the least room that still holds the piece),
emits sequences that are full or nearly so, and passes the underfull ones on as items.  The items of several partitions
meet in fewer partitions, are packed again by best fit, and so on until no two of them can meet.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkfold.llm.scratch import stored

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
_CHUNKS = 300_000
_PIECES = 200_000


class WordEncoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, with common words remembered.

    The tokenizer drops white space and never joins tokens across it, so a text's ids are its words' ids in turn.
    A word is cut further, by the tokenizer's own pattern, into pieces that are encoded apart: their UTF-8 bytes, each shown as a character, go to the
    tokenizer's model.  That holds for composed Latin and Cyrillic letters; words with other ones, and texts with control characters, for which
    white space is not what ``str.split`` takes it to be, are encoded whole.  So are texts that hold a special token, which may be joined to a word.
    """

    # Fixed value: the pattern by which this vocabulary's tokenizer cuts words.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    #: Marks that the pattern takes together behind letters; an apostrophe may begin a piece of its own.
    MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cut = regex.compile(self.PATTERN).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = regex.compile(r"[\x00\x1c-\x1f\x85]").search
        self.plain = regex.compile(r"[\x21-\u012f\u0131-\u024f\u0400-\u04ff]+").fullmatch  # but for a dotted capital I
        # printable bytes are shown as themselves, the others as the characters from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.shown = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.ids = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        ids = self.ids
        return b"".join([ids[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            ids = self.ids
            shown = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.shown)
            found = b"".join([ids[t.id] for t in self.model.tokenize(shown)])
            if len(self.parts) < _PIECES:
                self.parts[part] = found
        return found

    def word(self, word: str) -> bytes:
        if word.isascii() or (self.plain(word) and unicodedata.is_normalized("NFC", word)):
            low = word.lower()
            core = low.rstrip(self.MARKS)
            if core.isalpha():  # letters, and marks behind them: one piece each
                ids = self.part(core) + self.part(low[len(core) :]) if len(core) < len(low) else self.part(core)
            else:
                ids = b"".join(map(self.part, self.cut(low)))
        else:
            ids = self.whole(word)
        if len(self.words) < _CHUNKS:
            self.words[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.odd(text) or any(token in text for token in self.special):
            return self.whole(text)
        words = text.split()
        found = list(map(self.words.get, words))
        if None in found:
            found = [self.word(w) if x is None else x for w, x in zip(words, found, strict=True)]
        return b"".join(found)


_encoders: dict[str, WordEncoder] = {}


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every document: its ids, then ``end_id``.

    A null or empty text has the end id alone.  Rows with a null ``doc_id`` keep it; repeated rows give repeated pieces.
    """
    end, width = end_id.to_bytes(4, "little"), 4 * capacity

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoders.get(tokenizer_path) or _encoders.setdefault(tokenizer_path, WordEncoder(tokenizer_path))
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encoder.encode(text) + end
                for k, at in enumerate(range(0, len(ids), width)):
                    piece = ids[at : at + width]
                    rows.append((doc, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(cut, PIECE_SCHEMA)


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item, by best fit in the given order; bins are numbered as they are opened.

    Open bins are kept by their room, and a bit set of the rooms in use gives the least room that holds an item.
    """
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins, out = 0, 0, []
    for size in sizes:
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            found = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            found, room, bins = bins, capacity, bins + 1
        out.append(found)
        if room > size:
            by_room[room - size].append(found)
            rooms |= 1 << (room - size)
    return out


def pack(pieces: DataFrame, capacity: int = 2048, slack: int = 8, partition_items: int = 20_000) -> DataFrame:
    """Give every piece a ``sequence_id`` and its ``offset`` there.

    pieces: PIECE_SCHEMA, with lengths from 1 to ``capacity``; ``slack``: a sequence with at most so much room left is emitted
    in the round that fills it; ``partition_items``: items that one task packs at a time, in any round.  Ties are broken by
    (doc_id, piece), so a retried task packs alike.  An empty table gives an empty result.
    """
    # a bin's members stay with it, so only underfull bins move on
    fields = ["doc_id", "piece", "start", "length", "ids_crc32"]
    items = pieces.select(
        F.col("length").cast("int").alias("size"),
        F.array(F.struct(*fields, F.lit(0).cast("long").alias("offset"))).alias("members"),
    )
    member = "doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint"
    schema = f"done boolean, sequence_id long, size int, members array<struct<{member}>>"

    def packer(round_no: int, last: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            at = TaskContext.get().partitionId()
            held = [(int(s), m) for b in batches for s, m in zip(b["size"], b["members"], strict=True)]
            first = [(m[0]["doc_id"] if m[0]["doc_id"] is not None else -1, m[0]["piece"], m[0]["ids_crc32"]) for _, m in held]
            order = sorted(range(len(held)), key=lambda i: (-held[i][0], first[i]))
            bins: dict[int, list[int]] = {}
            for i, b in zip(order, best_fit([held[i][0] for i in order], capacity), strict=True):
                bins.setdefault(b, []).append(i)
            out = []
            for b, inside in bins.items():
                size, members = 0, []
                for i in inside:
                    for x in held[i][1]:
                        members.append({**{f: x[f] for f in fields}, "offset": size})
                        size += x["length"]
                done = last or size >= capacity - slack
                out.append((done, (round_no << 56) | (at << 30) | b, size, members))
                if len(out) >= 2_000:
                    yield pd.DataFrame(out, columns=["done", "sequence_id", "size", "members"])
                    out = []
            yield pd.DataFrame(out, columns=["done", "sequence_id", "size", "members"])

        return run

    parts, round_no, finished = max(1, math.ceil(pieces.count() / partition_items)), 0, []
    while True:
        # deal out by the first member, so that a retry sees the same partition
        dealt = items.repartition(parts, F.xxhash64(F.col("members")[0]["doc_id"], F.col("members")[0]["piece"]))
        packed = stored(dealt.mapInPandas(packer(round_no, last=parts == 1), schema), f"packed{round_no}")
        finished.append(packed.filter("done"))
        if parts == 1:
            break
        left = packed.filter("not done")
        # two sequences of one partition never fit together, so at most one of each is half empty, and any two that still meet include such a one
        small = left.filter(2 * F.col("size") <= capacity)
        few = small.agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("least")).first()
        if not few["n"]:
            finished.append(left)
            break
        # of those over half full, as many as there are half empty ones, the emptiest: if any other could take one, so could these
        others = left.filter((2 * F.col("size") > capacity) & (F.col("size") <= capacity - few["least"])).orderBy("size", "sequence_id").limit(few["n"])
        chosen = stored(small.unionByName(others), f"underfull{round_no}")
        finished.append(left.join(chosen.select("sequence_id"), "sequence_id", "left_anti"))
        items, round_no = chosen.select("size", "members"), round_no + 1
        parts = min(parts - 1, math.ceil(2 * few["n"] / partition_items))
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out.select("sequence_id", F.explode("members").alias("m")).select(*[f"m.{f}" for f in fields], "sequence_id", "m.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """Tokenise, cut and pack ``docs`` (doc_id, text; other columns are ignored)."""
    return pack(stored(token_pieces(docs, tokenizer_path, capacity), "pieces"), capacity)
