import duckdb
import pytest

from lexweave.functions import morphology as M

TAGS = duckdb.sql("select tag, packed from '/root/testdata/sf0.001/parsing_tags.parquet'").fetchall()


def test_valid_tags_read_and_write():
    for tag, packed in TAGS:
        if tag.startswith(("P-1", "P-2")):
            continue  # their number is that of whom they mean
        assert M.parse_byzantine(tag) == packed
        assert M.format_byzantine(packed) == tag


@pytest.mark.parametrize("tag, error", [("", "Incomplete"), ("M-GSF", "UnknownPartOfSpeech"), ("A-GS", "Incomplete"), ("V", "Incomplete"), ("N-NZ", "InvalidParsing"), ("N-NA", "InvalidParsing"), ("N-NSM+K", "InvalidParsing"), ("pn-nsm", "InvalidParsing")])
def test_errors(tag, error):
    assert M.read_tag("byzantine", tag) == (None, error)


def test_surroundings_and_case():
    assert M.parse_byzantine(" [N-NSM] ") == M.parse_byzantine("n-nsm") == 3 | 1 << 12 | 1 << 18 | 1 << 23
    assert M.parse_byzantine("V-2AAI-1S-ATT") == M.parse_byzantine("V-2AAI-1S")
    assert M.format_byzantine(M.parse_byzantine("P-1NS")) == "P-1NS"


def test_positional():
    assert M.parse_cntr("V       IAA3..S") == M.parse_byzantine("V-AAI-3S")
    assert M.parse_morphgnt("V- 1AAI-S--") == M.parse_byzantine("V-AAI-1S")
    assert M.parse_ccat("VF  FMI3S") == M.parse_byzantine("V-FMI-3S")
    assert M.parse_ccat("VBI AAI3S") == M.parse_byzantine("V-2AAI-3S")
    assert M.parse_cntr("N") == 3 and M.parse_morphgnt("C-") == 6
    assert M.unpack(M.parse_ccat("N1  GSF"))["gender"] == 2


def test_pack_roundtrip():
    for _, packed in TAGS:
        assert M.pack(**M.unpack(packed)) == packed
