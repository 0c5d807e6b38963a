import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import kernel

TEXTS = st.lists(st.text(alphabet=" \t\n\x0b\x0cab é.|\x1c", max_size=40), max_size=8)


def spans(texts, **kw):
    column = pa.array(texts, pa.string())
    out = []
    for _, _, data, offsets in kernel.chunks(column, 16):
        w = kernel.words(data, offsets, **kw)
        for i in range(len(offsets) - 1):
            out.append([(data[a:b].tobytes(), int(h)) for a, b, h in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]], w.hashes[w.first[i] : w.first[i + 1]])])
    return out


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_and_hashes(texts):
    found = spans(texts)
    assert [[w for w, _ in x] for x in found] == [t.encode().split() for t in texts]
    seen = {}
    for w, h in (p for x in found for p in x):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=40, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_windows(texts, width):
    column = pa.array(texts, pa.string())
    seen, back = {}, {}
    for _, _, data, offsets in kernel.chunks(column):
        w = kernel.words(data, offsets)
        at, h = kernel.windows(w.hashes, w.first, width)
        expected = [tuple(t.encode().split()[i : i + width]) for t in texts for i in range(len(t.encode().split()) - width + 1)]
        assert len(at) == len(expected)
        for key, x in zip(expected, h.tolist()):
            assert seen.setdefault(key, x) == x and back.setdefault(x, key) == key


def test_nulls_and_slices():
    column = pa.array(["x", None, "a b", ""]).slice(1)
    assert [[w for w, _ in x] for x in spans(column.to_pylist())] == [[], [b"a", b"b"], []]
    assert list(kernel.chunks(pa.array([], pa.string()))) == []


def test_case_and_punctuation():
    assert spans(["A.b"], between=kernel.NOT_ALNUM, lower=True)[0][0][1] == spans(["a"])[0][0][1]


@pytest.mark.parametrize("at", [[], [0], [0, 2, 3]])
def test_covered(at):
    expected = [any(a <= i < a + 3 for a in at) for i in range(7)]
    assert kernel.covered(7, np.array(at, np.int64), 3).tolist() == expected


def thue_morse(n, a="a", b="b"):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


@pytest.mark.parametrize("n", [64, 128, 1024, 4096])
def test_words_that_defeat_polynomial_hashes(n):
    one, other = thue_morse(n), thue_morse(n, "b", "a")
    (found,) = spans([f"{one} {other}"])
    assert found[0][1] != found[1][1]


def test_windows_of_words_that_defeat_polynomial_hashes():
    one, other = (" ".join(thue_morse(16, *x)) for x in ("ab", "ba"))
    data = np.frombuffer(f"{one} {other}".encode(), np.uint8)
    w = kernel.words(data, np.array([0, len(data)]))
    assert len(set(kernel.windows(w.hashes, w.first, 16)[1].tolist())) == len(set(zip(*[f"{one} {other}".split()[i:] for i in range(16)])))


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 9))
def test_long_texts_are_cut_at_gaps(texts, piece):
    """Words, spans and hashes don't depend on where a long text is cut."""
    whole = spans(texts)
    old, kernel.PIECE = kernel.PIECE, piece
    try:
        assert spans(texts) == whole
    finally:
        kernel.PIECE = old


def test_second_hash_is_another():
    data = np.frombuffer(b"abc " + b"x" * 100, np.uint8)
    w = kernel.words(data, np.array([0, len(data)]))
    assert (w.hashes != kernel.span_hashes(data, w.starts, w.ends, 1)).all()


def test_freed_memory_goes_back_to_the_system():
    """A worker's many small arrays, freed below one that stays, don't stay resident until the next stage."""
    import os

    from tessera.llm import common

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20

    held = [np.ones(4096) for _ in range(8000)]
    full, last = resident(), held[-1]
    del held
    common.give_back()
    assert resident() < full - 200 and last.all()
