import pytest

from tallyloom.cli import to_sql
from tallyloom.plans.normalize import Classes, Interval, normalize, reduce_ranges
from tallyloom.plans.spec import Col, Filter, Join, QueryError, parse_predicates, parse_query


def test_predicates():
    joins, filters = parse_predicates("0.1=111&1.2<222&1.1>333")
    assert joins == [] and [f.op for f in filters] == ["=", "<", ">"]
    joins, filters = parse_predicates("0.1=111&1.2=2.1&1.2<333")
    assert joins == [Join(Col(1, 2), Col(2, 1))] and len(filters) == 2
    assert parse_predicates("") == ([], [])


def test_query():
    q = parse_query("0 2 4|0.1=1.1&0.0=2.1&1.0=2.0&1.0>3|0.1 1.4 2.2")
    assert q.relations == (0, 2, 4) and len(q.joins) == 3 and q.filters == (Filter(Col(1, 0), ">", 3),)
    assert q.selections == (Col(0, 1), Col(1, 4), Col(2, 2))


def test_printing():
    text = "0 2|0.1=1.1&0.0=1.0&1.2=3|0.1 1.4"
    assert parse_query(text).to_text() == text
    sql = 'SELECT SUM("0".c1), SUM("1".c4) FROM r0 "0", r2 "1" WHERE "0".c1="1".c1 and "0".c0="1".c0 and "0".c1=5;'
    assert parse_query("0 2|0.1=1.1&0.0=1.0&0.1=5|0.1 1.4").to_sql() == sql
    assert list(to_sql(["0 2|0.1=1.1&0.0=1.0&0.1=5|0.1 1.4", "F", ""])) == [sql]


@pytest.mark.parametrize("text", ["0|0.0=1", "x|0.0=1|0.0", "0 1|0.0<1.0|0.0", "0|0.0=18446744073709551616|0.0", "0|0.0!1|0.0", "0|0.0=1|0"])
def test_refused(text):
    with pytest.raises(QueryError):
        parse_query(text)


@pytest.mark.parametrize("text", ["0 1|0.0=0.1|0.0", "0 1 2|0.0=1.0|0.0", "0||1.0", "0||", "0||0.9"])
def test_unanswerable(text):
    with pytest.raises(QueryError):
        parse_query(text).check(lambda r: 3)


@pytest.mark.parametrize(
    "filters,expected",
    [("<5&=5", None), (">7&<5", None), (">7&>9", [(">", 9)]), (">3&<5", [("=", 4)]), ("=5&<9", [("=", 5)]), ("=5&=6", None), (">0&<18446744073709551615", [(">", 0), ("<", 18446744073709551615)]), ("<0", None), (">18446744073709551615", None)],
)
def test_ranges(filters, expected):
    parsed = tuple(Filter(Col(0, 0), f[0], int(f[1:])) for f in filters.split("&"))
    ranges, impossible = reduce_ranges(parsed, Classes())
    assert impossible == (expected is None)
    if expected is not None:
        assert [(f.op, f.value) for f in ranges[Col(0, 0)].filters(Col(0, 0))] == expected


def test_interval_covers_a_class():
    n = normalize(parse_query("0 1|0.0=1.0&0.0<3&1.0>3|1.0"))
    assert n.impossible
    n = normalize(parse_query("0 1|0.0=1.0&1.0=0.0&0.0<3|0.1 0.1 1.0 0.0"))
    assert len(n.spec.joins) == 1 and n.answers == [0, 0, 1, 1] and len(n.spec.filters) == 2
    assert Interval(3, 2).empty
