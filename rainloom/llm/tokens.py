"""Token counts and ids under the word-end byte-pair vocabulary.

A text falls into chunks at ASCII white space; no token spans two chunks, so results are kept by chunk.
``count_tokens`` merges pairs itself and gives counts only; ``ids`` takes the tokenizers library's merges.
Where Python's Unicode tables and the library's differ, the library's normaliser and splitter are asked.
Null and empty texts have no tokens; rows are independent, so repeated rows give repeated results and an
empty table none. A very long text is counted chunk by chunk, one row at a time.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache
from itertools import islice
from struct import pack

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainloom.llm.common import Cache, map_texts, narrow

LIMIT = 2048
#: Unicode white space, as the vocabulary's pattern means it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Words:
    """Results by chunk and by word of a chunk (``word`` gives the latter) under one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        found = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile(f"({'|'.join(map(regex.escape, found))})") if found else None
        pattern = next(p["pattern"]["Regex"] for p in self.spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern.replace(r"\s", _SPACE))
        self.symbol = _byte_symbols()
        self.byte = {c: b for b, c in enumerate(self.symbol)}
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.agreed: set[str] = set()  # characters that Python and the library take alike
        self.chunks, self.words = Cache(), Cache(200_000)

    def word(self, word: str):
        raise NotImplementedError

    def symbols(self, word: str) -> str:
        if word.isascii() and word.isprintable() and " " not in word:  # these stand for themselves
            return word
        return "".join(map(self.symbol.__getitem__, word.encode()))

    def split(self, chunk: str) -> list[str]:
        """Words of a chunk, special strings among them."""
        if self.marks is None or "<" not in chunk:
            return self._plain(chunk)
        return [w for k, part in enumerate(self.marks.split(chunk)) for w in ([part] if k % 2 else self._plain(part))]

    def _plain(self, text: str) -> list[str]:
        if not text.isascii() and not (self.agreed.issuperset(text) or all(map(self._agrees, set(text)))):
            return self._library(text)
        return self._python(text)

    def _python(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case letter by letter
        return self.pieces.findall(text.lower())

    def _library(self, text: str) -> list[str]:
        """The library's own words: its Unicode tables may be of another version."""
        found = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))
        return [bytes(map(self.byte.__getitem__, w)).decode() for w, _ in found]

    def _agrees(self, c: str) -> bool:
        """Whether both split and lower a character alike, alone and beside letters, digits and marks."""
        if c not in self.agreed and all(self._python(t) == self._library(t) for t in (c, f"a{c}a", f"1{c}1", f".{c}.", f"A{c}{c}")):
            self.agreed.add(c)
        return c in self.agreed

    def by_chunk(self, chunks: list[bytes]) -> list[list]:
        """The words' results of each chunk."""
        split = [self.split(c.decode()) for c in chunks]
        found = iter(self.words.all([w for ws in split for w in ws], lambda new: list(map(self.word, new))))
        return [list(islice(found, len(ws))) for ws in split]

    def of(self, text: str, join) -> list:
        return self.chunks.all(text.encode().split(), lambda new: list(map(join, self.by_chunk(new))))


class PairCounter(Words):
    """Tokens of a word: symbols at first minus merges, by a heap over a linked list of symbols."""

    def __init__(self, path: str):
        super().__init__(path)
        model = self.spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {p: k for k, p in enumerate(pairs)}

    def merges(self, symbols: list[str]) -> int:
        """How many merges ``symbols`` undergo: the lowest-rank adjacent pair first, the leftmost among equals."""
        n, rank = len(symbols), self.rank
        after, before = list(range(1, n)) + [-1], list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := rank.get((a, b))) is not None]
        heapq.heapify(heap)
        done = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:  # one of the two has been merged meanwhile
                continue
            symbols[i], symbols[j] = a + b, ""
            done += 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank.get((a + b, symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, a + b, symbols[k]))
            if (h := before[i]) >= 0 and (r := rank.get((symbols[h], a + b))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], a + b))
        return done

    def word(self, word: str) -> int:
        if word in self.special:
            return 1
        symbols = list(self.symbols(word))
        symbols[-1] += self.end
        return len(symbols) - self.merges(symbols)

    def count(self, text: str) -> int:
        return sum(self.of(text, sum))


def _byte_symbols() -> list[str]:
    """The visible character that stands for each byte: itself if printable in Latin-1, else the next free one from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in plain else next(free)) for b in range(256)]


@lru_cache(maxsize=2)
def pair_counter(path: str) -> PairCounter:
    return PairCounter(path)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether they are more than ``limit``."""
    path = path or vocabulary()

    def run(batch):
        counter, texts = pair_counter(path), batch.column("text").to_pylist()
        counts = [counter.count(t) for t in texts]
        return {"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "n_tokens": counts, "over_limit": [n > limit for n in counts]}

    df = narrow(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return map_texts(df, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


class Ids(Words):
    """The library's ids of a text as little-endian 32-bit integers."""

    def __init__(self, path: str):
        super().__init__(path)
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path).model

    def word(self, word: str) -> bytes:
        found = [self.special[word]] if word in self.special else [t.id for t in self.model.tokenize(self.symbols(word))]
        return pack(f"<{len(found)}I", *found)

    def text(self, text: str) -> bytes:
        return b"".join(self.of(text, b"".join))


@lru_cache(maxsize=2)
def ids(path: str) -> Ids:
    return Ids(path)
