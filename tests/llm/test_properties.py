"""Properties over random inputs."""

from array import array

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lathe.llm import bit_sliced, feistel, packing, role_repair, wrapper

TEXT = st.text(st.sampled_from("ab'sS t  \n\t\r  é1,.!?<>|\U0001f600-_中"), max_size=60)


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out.encode_special_tokens = True
    return out, packing.encoder(*packing.public_vocabulary(), cached=50)


def test_cached_words_give_the_tokenizer_ids(tokenizer):
    exact, ours = tokenizer

    @settings(max_examples=1500, deadline=None)
    @given(TEXT)
    def same(text):
        assert list(array("H", ours(text))) == exact.encode(text, add_special_tokens=False).ids

    same()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 99))
def test_permutations_are_bijections(n, seed):
    assert np.array_equal(np.sort(feistel.permute(np.arange(n), n, seed)), np.arange(n))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.integers(1, 5))
def test_fragments_compose(roles, size):
    whole = role_repair.close(role_repair.solve(roles)[0])[0]
    parts = [role_repair.solve(roles[i : i + size])[0] for i in range(0, len(roles), size)]
    ways = role_repair.compose(parts)
    assert sum(c[a][b] for c, (a, b) in zip(parts, ways, strict=True)) + role_repair.INSERT * len(role_repair.ending(ways[-1][1])) == whole


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-700, 700), min_size=3, max_size=3), min_size=2, max_size=70), st.integers(1, 12))
def test_slices_find_the_best(rows, k):
    values, ids = np.array(rows), np.arange(len(rows))
    got = bit_sliced.search_block(ids, values, ids[:2], values[:2], k)
    for q in (0, 1):
        want = sorted((-int(values[i] @ values[q]), i) for i in ids if i != q)[:k]
        assert sorted((-s, i) for a, i, s in got if a == q) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=ad>", "</div>", "<article>", "</article>", "<ul><li>", "a b", "&amp", "<!--", "-->", "<script>", "</script>", "<a href='x>", "<", ">", '"', "<br/>", " "]), max_size=25))
def test_any_markup_is_read(parts):
    page = "".join(parts)
    text = wrapper.extract(page, wrapper.induce([page, page + "<p>x", "<p>y"]))
    assert "\n\n\n" not in text and text == text.strip()
