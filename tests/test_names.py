import pytest

from deltaloom.functions.names import canonical, format_position, parse_name, parse_position


def test_names_fold_and_quote():
    assert parse_name("Orders") == ("public", "orders")
    assert parse_name('shop."My Table"') == ("shop", "My Table")
    assert canonical('SHOP."ok"') == "shop.ok"
    assert canonical('"A""b"') == 'public."A""b"'


@pytest.mark.parametrize("bad", ["", "a.b.c", "a.", "1x", 'a."'])
def test_bad_names(bad):
    with pytest.raises(ValueError):
        parse_name(bad)


def test_positions_round_trip():
    for lsn in (0, 8, 1 << 32, (1 << 63) - 1):
        assert parse_position(format_position(lsn)) == lsn
    assert format_position(0x16B374D848) == "16/B374D848"
    with pytest.raises(ValueError):
        parse_position("x")
