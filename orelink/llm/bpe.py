"""Byte-level BPE encoding and decoding with DuckDB recursive queries in each partition.

A text splits into the matches of the tokenizer's pattern. The distinct new words of an Arrow batch become
token-position rows, one per byte, each with the token and position that follow. A recursive query joins the rows with the
merge table, contracts each word's leftmost pair of least rank, and repeats until no word has a pair left; an ordered
aggregation turns the rows of each word into its ids. Decoding is a query over (sequence, position, id) rows alone: a join with
the vocabulary and an ordered aggregation of the token bytes. ``digests`` decodes every text from its own ids.
A round of the recursive query contracts one pair a word, so a word costs its square; words over ``LONG_WORD`` bytes
are contracted by a heap of pairs with the same order (least rank, then leftmost).

Scale: narrow, no shuffle. A worker keeps at most ``CACHE`` encoded words and DuckDB has one thread and a
bounded memory; sequences are decoded in pieces of ``PIECE`` ids. The merge table comes from the rank file (its path is a
parameter) once per worker.

Defined cases: a null text is empty: no tokens, the digests of empty input; a null doc_id keeps its row; a null id list decodes to
empty bytes; repeated rows repeat; texts of any length are read whole; ties of rank go to the leftmost pair; an empty table gives no rows;
special tokens are ordinary text; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator, Set
from functools import cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from orelink.llm.common import texts

CACHE = 400_000
LONG_WORD = 512
BATCH_BYTES = 400_000
GROUP_CHARS = 4_000_000
PIECE = 200_000
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

CONTRACT = """
WITH RECURSIVE step AS (
    SELECT s.*, m.rank::BIGINT * 65536 + s.pos AS here, false AS done
    FROM start s LEFT JOIN merges m ON m.pair = s.tok::BIGINT * 4294967296 + s.next
    UNION ALL
    SELECT n.word, n.pos, n.tok, n.npos, n.next, CASE WHEN n.changed THEN m.rank::BIGINT * 65536 + n.pos ELSE n.here END, n.done
    FROM (
        SELECT s.word, s.pos, s.here,
               CASE WHEN s.here = c.best THEN c.merged ELSE s.tok END AS tok,
               CASE WHEN s.here = c.best THEN c.npos ELSE s.npos END AS npos,
               CASE WHEN s.here = c.best THEN c.next WHEN s.npos = c.pos THEN c.merged ELSE s.next END AS next,
               coalesce(s.here = c.best OR s.npos = c.pos, false) AS changed, c.best IS NULL AS done
        FROM step s LEFT JOIN (
            SELECT least.word, best, (best >> 16)::INTEGER AS merged, best & 65535 AS pos, second, f.npos, f.next
            FROM (SELECT word, min(here) AS best, arg_min(npos, here) AS second FROM step WHERE NOT done AND here IS NOT NULL GROUP BY word) least
            JOIN step f ON f.word = least.word AND f.pos = second
        ) c ON c.word = s.word
        WHERE NOT s.done AND (c.best IS NULL OR s.pos <> c.second)
    ) n LEFT JOIN merges m ON m.pair = CASE WHEN n.changed THEN n.tok::BIGINT * 4294967296 + n.next END
)
SELECT word, pos, tok FROM step WHERE done
"""
WORDS = f"SELECT word, string_agg(tok::VARCHAR, ',' ORDER BY pos) AS ids FROM ({CONTRACT}) GROUP BY word"
DECODE = "SELECT seq, string_agg(hex, '' ORDER BY pos) AS hex FROM ids JOIN vocabulary USING (tok) GROUP BY seq"


# White space of the Unicode property that \\s stands for, and the letters and numbers from U+00A1 to U+02AF.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ʯ", "0-9²³¹¼½¾"


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of the pattern. Texts of plain and Latin characters alone go to the faster standard module."""
    full = regex.compile(pattern.replace(r"\s\p", SPACES + r"\p").replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]")).findall
    latin = re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{LETTERS}{NUMBERS}]").replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", f"[{NUMBERS}]")).findall
    other = re.compile("[^\t\n\r\x20-\x7e\xa1-\u02af]").search
    return lambda text: full(text) if other(text) else latin(text)


class Codec:
    """Encoder and decoder of one rank file inside a Python worker."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = splitter(pattern)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        pairs = [(self.ranks[t[:i]] << 32 | self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self._table("merges", pair=pa.array([p for p, _ in pairs], pa.int64()), rank=pa.array([r for _, r in pairs], pa.int32()))
        self._table("vocabulary", tok=pa.array(self.ranks.values(), pa.int32()), hex=pa.array([t.hex() for t in self.ranks]))
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.ids: dict[str, str] = {}  # the ids of each word, joined by commas

    def _table(self, name: str, **columns: pa.Array) -> None:
        rows = pa.table(columns)
        self.db.register("_rows", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM _rows")
        self.db.unregister("_rows")

    def _contract(self, words: list[str], raw: list[bytes]) -> None:
        lengths = np.fromiter(map(len, raw), np.int32, len(raw))
        at = np.repeat(np.cumsum(lengths) - lengths, lengths)
        codes = np.frombuffer(b"".join(raw), np.uint8)
        word, pos, tok = np.repeat(np.arange(len(raw), dtype=np.int32), lengths), (np.arange(len(codes)) - at).astype(np.int32), self.first[codes]
        last = np.append(word[1:] != word[:-1], True)
        self._table("start", word=pa.array(word), pos=pa.array(pos), tok=pa.array(tok), npos=pa.array(pos + 1), next=pa.array(np.append(tok[1:], tok[:1]), mask=last))
        self.ids.update((words[i], ids) for i, ids in self.db.execute(WORDS).fetchall())

    def _contract_long(self, word: bytes) -> list[int]:
        ids: list[int | None] = [self.ranks[bytes([b])] for b in word]
        spans, nxt, prev = [word[i : i + 1] for i in range(len(word))], list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        rank = lambda i: self.ranks.get(spans[i] + spans[nxt[i]]) if nxt[i] < len(word) else None
        heap = [(r, i, len(spans[i] + spans[i + 1])) for i in range(len(word) - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, _ = heapq.heappop(heap)
            if ids[i] is None or rank(i) != r:
                continue
            j = nxt[i]
            ids[i], spans[i], ids[j], nxt[i] = r, spans[i] + spans[j], None, nxt[j]
            if nxt[i] < len(word):
                prev[nxt[i]] = i
            for k in (prev[i], i):
                if k >= 0 and (again := rank(k)) is not None:
                    heapq.heappush(heap, (again, k, 0))
        return [t for t in ids if t is not None]

    def learn(self, words: Set[str]) -> None:
        """Encode the words not known yet, in recursive queries over at most BATCH_BYTES bytes or one word."""
        if len(self.ids) > CACHE:
            self.ids.clear()
        new = sorted(words - self.ids.keys())
        some, raw, size = [], [], 0
        for w in new:
            b = w.encode()
            if len(b) > LONG_WORD:
                self.ids[w] = ",".join(map(str, self._contract_long(b)))
                continue
            some.append(w), raw.append(b)
            size += len(b)
            if size > BATCH_BYTES:
                self._contract(some, raw)
                some, raw, size = [], [], 0
        if some:
            self._contract(some, raw)

    def split(self, texts: list[str]) -> Iterator[list[list[str]]]:
        """The words of the texts, in groups of texts whose words are all known when they are given out."""
        group, new, size = [], {}, 0
        for i, t in enumerate(texts):
            words = self.find(t)
            group.append(list(map(new.setdefault, words, words)))  # one object for each distinct word
            size += len(t)
            if size > GROUP_CHARS or i == len(texts) - 1:
                self.learn(new.keys())
                yield group
                group, new, size = [], {}, 0

    def joined(self, words: list[str]) -> str:
        """The ids of known words, joined by commas."""
        return ",".join(map(self.ids.__getitem__, words))

    def decode(self, lists: list[np.ndarray]) -> list[bytes]:
        """The bytes of each id list, by ordered aggregation over pieces of bounded size."""
        pieces = [(k, x[at : at + PIECE]) for k, x in enumerate(lists) for at in range(0, len(x), PIECE)]
        data: list[list[bytes]] = [[] for _ in lists]
        part, size = [], 0
        for n, (k, x) in enumerate(pieces, 1):
            part.append((k, x))
            size += len(x)
            if size >= PIECE or n == len(pieces):
                lengths = np.array([len(x) for _, x in part])
                pos = np.arange(size) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                self._table("ids", seq=pa.array(np.repeat(np.arange(len(part), dtype=np.int32), lengths)), pos=pa.array(pos.astype(np.int32)), tok=pa.array(np.concatenate([x for _, x in part])))
                for i, text in sorted(self.db.execute(DECODE).fetchall()):
                    data[part[i][0]].append(bytes.fromhex(text))
                part, size = [], 0
        return [b"".join(x) for x in data]


def parsed(ids: str) -> np.ndarray:
    return np.fromstring(ids, np.int32, sep=",") if ids else np.zeros(0, np.int32)


@cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the token ids of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            doc_ids, at = b.column("doc_id"), 0
            for group in c.split(b.column("text").to_pylist()):
                ids = [parsed(c.joined(words)) for words in group]
                yield pa.RecordBatch.from_arrays([doc_ids.slice(at, len(group)), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
                at += len(group)

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, data): the bytes of each id list; a null list gives empty bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            data = c.decode([np.array(x or [], np.int32) for x in b.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document the token count, and SHA-256 of the comma-joined ids and of the bytes that these ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            doc_ids, at = b.column("doc_id"), 0
            for group in c.split(b.column("text").to_pylist()):
                ids = [c.joined(words) for words in group]
                lists = [parsed(x) for x in ids]
                rows = [(len(n), hashlib.sha256(x.encode()).hexdigest(), hashlib.sha256(data).hexdigest()) for x, n, data in zip(ids, lists, c.decode(lists))]
                columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([doc_ids.slice(at, len(group)), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(group)

    return texts(docs).mapInArrow(run, DIGESTS)
