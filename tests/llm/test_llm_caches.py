"""Word caches: emptied when their worker goes on to another operator, and no known word is looked up twice."""

import pyarrow as pa

from rainloom.llm.common import Cache, bounded


def _task():
    return list(bounded(iter([pa.RecordBatch.from_pydict({"text": ["some words"]})]), "text"))


def test_idle_caches_are_emptied():
    cache = Cache()
    cache.all(["a"], lambda new: list(map(len, new)))
    _task()  # the task that used it
    assert cache.new == {"a": 1}
    list(bounded(iter([]), "text"))  # a task without rows tells nothing
    assert cache.new == {"a": 1}
    cache.all(["a"], lambda new: list(map(len, new)))
    _task()
    assert cache.new == {"a": 1}
    _task()  # another operator's
    assert not cache.new and not cache.old
    assert cache.all(["a", "b"], lambda new: list(map(len, new))) == [1, 1]


def test_known_words_are_looked_up_once():
    class Word(str):
        asked = 0

        def __hash__(self):
            self.asked += 1
            return super().__hash__()

    cache, known = Cache(), Word("known")
    cache.all(["known"], lambda new: list(map(len, new)))
    assert cache.all([known, "new", known], lambda new: list(map(len, new))) == [5, 3, 5]
    assert known.asked == 2


def test_words_that_stand_for_themselves():
    from rainloom.llm.tokens import Ids, vocabulary

    ids = Ids(vocabulary())
    for word in ["plain", "~!", "a b", "é", "\x7f", "\x00a", "", "".join(map(chr, range(128)))]:
        assert ids.symbols(word) == "".join(map(ids.symbol.__getitem__, word.encode()))
