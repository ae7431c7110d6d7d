import numpy as np
import pytest

from furrow.llm import sentence_spans, shingle_join
from furrow.llm.hashing import word_hashes, words


def thue_morse(size, letters="ab"):
    return "".join(letters[bin(i).count("1") & 1] for i in range(size))


@pytest.mark.parametrize("size", [128, 256, 1024, 4096, 8192])
def test_thue_morse_words_differ(size):
    data = np.frombuffer(f"{thue_morse(size)} {thue_morse(size, 'ba')} {thue_morse(size)}".encode(), np.uint8)
    a, b, again = word_hashes(data, *words(data, np.array([0, len(data)]))[:2])
    assert a != b and a == again


def test_long_words_do_not_link_documents(frame):
    rest = [f"w{i}" for i in range(16)]
    texts = [" ".join([*rest[:8], thue_morse(1024, letters), *rest[8:]]) for letters in ("ab", "ba")]
    got = shingle_join.component_ids(frame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == {0: 0, 1: 1}


def test_sentences_of_thue_morse_words_differ(frame):
    texts = [f"{' '.join(thue_morse(2048, letters))}. The end is here." for letters in ("ab", "ba")]
    got = sentence_spans.dedup(frame(list(enumerate(texts)), "doc_id long, text string"))
    assert [r.n_removed for r in got.collect()] == [0, 0]
