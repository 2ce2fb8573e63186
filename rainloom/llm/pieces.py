"""Encoding and decoding with a merge-type SentencePiece vocabulary.

No piece has the word mark after another character, so a text falls into chunks (word marks, then other
characters) that are encoded on their own. Within a chunk the longest matches of an Aho-Corasick
automaton are tried first. A sequence of pieces is the encoding exactly if each two neighbours, merged
again from their characters, come out as the same two pieces; where they don't, the search steps back,
and a bitfield remembers positions from which no encoding goes on. Characters outside the vocabulary
become their bytes.

Null and empty texts give the begin and end ids only; rows are independent, so repeated rows give repeated
results and an empty table none. A very long text is encoded chunk by chunk, one row at a time; chunks above
``Cache.LONG`` characters are not remembered.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import pairwise

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from rainloom.llm.common import Cache, map_texts, narrow

MARK = "▁"
#: White space runs stay with the word that follows; a line feed is never part of a piece of words.
_CHUNKS = re.compile(" *[^ \n]+|\n| +")


def model(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Merger:
    """Pieces, ids and byte strings of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        size = range(p.get_piece_size())
        plain = [i for i in size if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        self.id = {p.id_to_piece(i): i for i in plain}
        self.code = {t: i.to_bytes(4, "little") for t, i in self.id.items()}
        self.score = {t: p.get_score(i) for t, i in self.id.items()}
        if any(MARK in t.lstrip(MARK) or "\n" in t for t in self.id):
            raise ValueError("a piece spans words; chunks would not be independent")
        if not {c for t in self.id for c in t} <= set(self.id):
            raise ValueError("a piece has a character that is no piece")
        self.byte = {int(p.id_to_piece(i)[3:5], 16): i for i in size if p.is_byte(i)}
        self.begin, self.end = p.bos_id(), p.eos_id()
        self.bytes = [b"" if p.is_control(i) else bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace(MARK, " ").encode() for i in size]
        self.raw = {i for i in size if p.is_byte(i)}
        self.find = ahocorasick.Automaton()
        for t in self.id:
            self.find.add_word(t, t)
        self.find.make_automaton()
        self.seen, self.pairs = Cache(), {}

    def merge(self, text: str) -> list[str]:
        """The pieces of ``text`` by merging: the best-scored pair first, the leftmost among equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        key = (a, b)
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > 400_000:
                self.pairs.clear()
            ok = self.pairs[key] = self.merge(a + b) == [a, b]
        return ok

    def longest(self, text: str) -> list[str] | None:
        """Longest matches from left to right, if they cover the text and fit one another."""
        found = [t for _, t in self.find.iter_long(text)]
        if sum(map(len, found)) != len(text):
            return None
        known = self.pairs.get
        for key in pairwise(found):
            ok = known(key)
            if not (self.fits(*key) if ok is None else ok):
                return None
        return found

    def search(self, text: str) -> list[str]:
        """The same with stepping back; ``text`` has known characters only."""
        n, known = len(text), self.pairs.get
        matches: list[list[str]] = [[] for _ in range(n)]  # at each position, the longest last
        for last, t in self.find.iter(text):
            matches[last - len(t) + 1].append(t)
        dead = 0  # bit p: nothing that goes on from position p is an encoding
        out: list[str] = []
        at, before, left = 0, None, matches[0][:] if n else []
        stack: list[list[str]] = []
        while at < n:
            while left:
                t = left.pop()
                end = at + len(t)
                if dead >> end & 1:
                    continue
                if before is not None:
                    ok = known((before, t))
                    if not (self.fits(before, t) if ok is None else ok):
                        continue
                out.append(t)
                stack.append(left)
                at, before = end, t
                left = matches[at][:] if at < n else []
                break
            else:
                dead |= 1 << at
                if not out:
                    raise ValueError("no encoding")
                at -= len(out.pop())
                before = out[-1] if out else None
                left = stack.pop()
        return out

    def chunk(self, chunk: str) -> bytes:
        """Little-endian 32-bit ids of a chunk."""
        text = chunk.replace(" ", MARK)
        found = self.longest(text)
        if found is not None:
            return b"".join(map(self.code.__getitem__, found))
        if self.id.keys() >= set(text):
            return b"".join(map(self.code.__getitem__, self.search(text)))
        out, known, start = [], self.id, 0
        for k in range(len(text) + 1):
            if k == len(text) or text[k] not in known:
                part = text[start:k]
                if part:
                    out += map(self.code.__getitem__, self.longest(part) or self.search(part))
                if k < len(text):
                    out += [self.byte[b].to_bytes(4, "little") for b in text[k].encode()]
                start = k + 1
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text with begin and end."""
        chunks = _CHUNKS.findall(" " + text.replace(MARK, " ")) if text else []
        inner = b"".join(self.seen.all(chunks, lambda new: list(map(self.chunk, new))))
        return self.begin.to_bytes(4, "little") + inner + self.end.to_bytes(4, "little")

    def decode(self, ids: bytes) -> str:
        """The text of ids: word marks become spaces, the first of which goes; bytes become characters."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        if numbers[:1] == [self.begin]:
            del numbers[0]
        if numbers[-1:] == [self.end]:
            del numbers[-1]
        raw = b"".join(map(self.bytes.__getitem__, numbers))
        try:
            text = self._loose(numbers) if self.end in numbers or self.begin in numbers else raw.decode()
        except UnicodeDecodeError:
            text = self._loose(numbers)
        first = next((i for i in numbers if self.bytes[i]), None)
        return text[1:] if first is not None and first not in self.raw and text[:1] == " " else text

    def _loose(self, numbers: list[int]) -> str:
        """Byte by byte: one that is not part of a character becomes U+FFFD."""
        out, run = [], bytearray()

        def close():
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + size]).decode())
                        at += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for i in numbers:
            if i in self.raw:
                run.extend(self.bytes[i])
            else:
                close()
                out.append(self.bytes[i].decode())
        close()
        return "".join(out)


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


def encode(docs: DataFrame, path: str | None = None, keep: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, number and digest of the ids, digest of the decoded text; with ``keep`` also ids and text themselves."""
    path = path or model()

    def run(batch):
        m = merger(path)
        ids = [m.encode(t) for t in batch.column("text").to_pylist()]
        back = [m.decode(i) for i in ids]
        out = {
            "doc_id": batch.column("doc_id"),
            "n_tokens": [len(i) // 4 for i in ids],
            "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
            "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in back],
        }
        return out | ({"ids": [np.frombuffer(i, "<u4").tolist() for i in ids], "decoded": back} if keep else {})

    return map_texts(narrow(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * keep)
