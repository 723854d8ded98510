"""Decoding in one pass: an ordered join, cut where documents end."""

from __future__ import annotations

import public_tokenizers
import pytest

from tillhouse.llm import byte_bpe
from tillhouse.llm.byte_bpe import Coder, read_ranks
from tillhouse.llm.queries import RANKS


@pytest.fixture(scope="module")
def coder() -> Coder:
    return Coder(read_ranks(public_tokenizers.path(RANKS)))


def test_decoding_groups_and_aggregates_nothing(coder):
    """An ordered aggregate per document took more than three times the CPU of the join."""
    coder.decode([(1).to_bytes(4, "little")])
    plan = coder.db.execute(f"EXPLAIN {byte_bpe.DECODE}").fetchall()[0][1].lower()
    assert "join" in plan and "group" not in plan and "aggregate" not in plan


@pytest.mark.parametrize("rows", [1, 2, 3, 5, 1000])
def test_documents_that_cross_the_rows_of_a_query(coder, monkeypatch, rows):
    monkeypatch.setattr(byte_bpe, "DECODE_ROWS", rows)
    texts = ["", "one two  three", "", "", "a\x00b\nä 漢字 🙂", "x", "", "the end of it all", ""]
    ids = coder.encode([[t[i : i + 4] for i in range(0, len(t), 4)] for t in texts])
    assert coder.decode(ids) == [t.encode() for t in texts]
    assert coder.decode(ids[:1]) == [b""] and coder.decode([]) == []


def test_an_unknown_id_is_an_error(coder):
    with pytest.raises(ValueError, match="vocabulary"):
        coder.decode([(1 << 30).to_bytes(4, "little")])
