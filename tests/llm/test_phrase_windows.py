"""Phrases counted from windows that are dealt over parts, against plain counting."""

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import WORDS  # noqa: E402
from test_vocabulary import FIELDS, phrases_by_hand  # noqa: E402

from wickerwork.llm import phrases  # noqa: E402


@pytest.mark.parametrize("part_windows", [40, 300])
def test_parts_do_not_change_phrases(spark, part_windows):
    rng = np.random.default_rng(3)
    # a few words are so common that phrases of them are dealt over several parts
    docs = [(i, ["en", "de", None][i % 3], " ".join(WORDS[min(int(x), 19)] + "." * int(rng.random() < 0.03) for x in rng.exponential(2.5, 90)))
            for i in range(40)]
    want = phrases_by_hand([d[1:] for d in docs], 5, 6, 300)
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    got = phrases.collocations(df, minimum=6, first=300, block_words=200, part_windows=part_windows)
    assert sorted(tuple(r[f] for f in FIELDS) for r in got.collect()) == want != []


def test_common_phrases_are_dealt_by_more_words():
    ids = np.array([1, 2, 3, 0, 1, 2, 4, 9, 1, 2, 3, 9])
    columns = phrases._windows(ids, 3)
    assert [c.tolist() for c in columns] == [[1, 2, 1, 2, 4, 9, 1, 2, 3], [2, 3, 2, 4, 9, 1, 2, 3, 9], [3, 0, 4, 9, 1, 2, 3, 9, 0]]
    whole, dealt = phrases._part(columns, 1 << 20, 0), phrases._part(columns, 1 << 20, 2)
    assert whole[0] == whole[2] == whole[6] and dealt[0] == dealt[6] != dealt[2]
    assert dealt[1] == whole[1] and dealt[7] == whole[7]
