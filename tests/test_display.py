import pytest
from pyspark.sql import functions as F

import recordlake as rl
from recordlake.operators.profile import MAX_COLUMNS, collect_profile
from recordlake.operators import profile as profiles

DIVES = [
    {"crew": "north", "depth": 40, "_note_file": "/log/dive1.md", "buddy": None},
    {"crew": "south", "depth": 12, "gas": "air", "_note_file": "/log/dive2.md"},
    {"crew": "east", "depth": 33, "site": "wreck"},
    {"crew": "west"},
]


def test_profile(records):
    rows = records(*DIVES, {"_hidden": 1})
    got = {r["key"]: (r["present"], r["non_null"], r["column_type"], r["fill_rate"]) for r in rl.column_profile(rows, rate=True).collect()}
    assert got["crew"] == (4, 4, "string", 0.8)
    assert got["buddy"] == (1, 0, "string", 0.0)
    assert got["depth"] == (3, 3, "bigint", 0.6)
    assert sorted(r["key"] for r in rl.field_keys(rows).collect()) == ["buddy", "crew", "depth", "gas", "site"]


def test_shown_columns(records):
    profile = collect_profile(records(*DIVES))
    assert rl.shown_columns(profile) == (["crew", "depth", "gas", "site"], 0)
    assert rl.shown_columns(profile, ["site", "nothing", "crew", "buddy"]) == (["site", "crew"], 0)
    assert rl.shown_columns(profile, budget=41) == (["crew", "depth"], 2)
    assert rl.shown_columns(profile, ["gas", "depth", "crew"], budget=59) == (["gas", "depth"], 1)
    assert rl.shown_columns(profile, budget=7)[0] == ["crew"]
    assert rl.shown_columns(profile, ["site"], override=["gas"]) == (["gas"], 0)
    assert rl.shown_columns(profile, ["site"], override=[]) == (["site"], 0)
    assert rl.shown_columns(profile, budget=41, lead_width=15)[0] == ["crew"]
    assert rl.shown_columns(profile, budget=30, widths={"crew": 30, "depth": 2})[0] == ["crew"]


def test_fitting_columns_agree(records):
    profile = rl.column_profile(records(*DIVES))
    rows = collect_profile(profile)
    for budget, widths in ((41, {}), (7, {}), (90, {"gas": 4}), (63, {"crew": 2}), (0, {"site": 1})):
        fit = sorted(r["key"] for r in profiles.fitting_columns(profile, budget, widths).collect())
        assert fit == rl.shown_columns(rows, budget=budget, widths=widths)[0]
    assert [r["key"] for r in rl.top_columns(profile, 3).orderBy("rank").collect()] == ["crew", "depth", "gas"]


def test_profile_refuses_unbounded_width(spark):
    wide = spark.range(MAX_COLUMNS + 1).select(
        F.map_from_arrays(F.array(F.concat(F.lit("k"), F.col("id"))), F.array(F.parse_json(F.lit("1")))).alias("fields")
    )
    with pytest.raises(ValueError):
        collect_profile(wide)


@pytest.mark.parametrize(
    "value, cell",
    [
        (None, ""), ("plain", "plain"), (7, "7"), (False, "false"), (2.25, "2.25"), ("3.0", "3.0"), ([], "[]"),
        (["p", "q", "r"], "[p q r]"), ([None, 2, False], "[<nil> 2 false]"), ({"z": 0, "k": "v"}, "map[k:v z:0]"),
        ("first\n\n  second", "first second"), ("\tx\n y ", "x y"), (" two  blanks ", " two  blanks "),
    ],
)
def test_cell_text(records, value, cell):
    assert rl.select_columns(records({"v": value, "k": 1}), ["v"]).first()["v"] == cell


def test_select_columns(records):
    rows = rl.select_columns(records(*DIVES), ["gas", "nope"])
    assert [tuple(r) for r in rows.orderBy("source").collect()][:2] == [("dive1.md", "", ""), ("dive2.md", "air", "")]
    assert rl.select_columns(records(*DIVES), ["crew"], lead=False).columns == ["crew"]


@pytest.mark.parametrize("value, text", [(None, "None"), (True, "True"), (False, "False"), (5, "5.0"), (5.5, "5.5"), ("5", "5"), (1e300, "1.0E300")])
def test_display_text(records, value, text):
    assert records({"v": value}).select(rl.display_text(F.col("fields")["v"])).first()[0] == text


def test_record_form(records):
    form = rl.record_form(F.col("fields"), F.col("_note_file"))
    one = records({"_note_file": "/n/a.md", "b": [1, "x", None], "a": True, "_m": 1, "n": None, "z": "t"}).select(form).first()[0]
    assert one == "a  True\nb  1.0, x, None\nz  t\n\nsource  /n/a.md"
    assert records({"_note_file": "", "n": None}).select(form).first()[0] == "(empty record)"
    assert records({"_note_file": "/n/a.md"}).select(form).first()[0] == "\nsource  /n/a.md"
    assert records({"n": None}).select(rl.record_form(F.col("fields"))).first()[0] == "(empty record)"


KEPT = "as is", "bell-free ümläut", "\x1b[1mbold\x1b[22m", "wide\u3000blank", "two\nlines"
DROPPED = [*range(0x00, 0x09), *range(0x0B, 0x1B), *range(0x1C, 0x20), *range(0x7F, 0xA0), 0xAD, 0xFEFF, *range(0x200B, 0x2010), *range(0x2028, 0x202F), *range(0x2060, 0x2065)]


def test_sanitize(spark):
    """Every invisible character goes, wherever it stands; a tab becomes a blank; everything else stays."""
    pairs = [(t, t) for t in KEPT] + [(f"{chr(c)}le{chr(c)}ft{chr(c)}", "left") for c in DROPPED] + [("one\ttwo", "one two")]
    pairs += [(f"a{chr(c)}b", f"a{chr(c)}b") for c in (0x1B, 0x0A, 0x20, 0xA0, 0x200A, 0x2010, 0x2027, 0x202F, 0x205F, 0x2065, 0xFEFE)]
    got = spark.createDataFrame(pairs, "dirty string, clean string").withColumn("got", rl.sanitize_text(F.col("dirty")))
    assert got.filter("got <> clean").collect() == []


def test_paths(spark):
    df = spark.createDataFrame([("/a/b.c/note.v1.md",), ("plain",), ("",)], "p string")
    assert [tuple(r) for r in df.select(rl.note_stem(F.col("p")), rl.source_column(F.col("p"))).collect()] == [
        ("note.v1", "note.v1.md"), ("plain", "plain"), ("", ""),
    ]
