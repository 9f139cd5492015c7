"""Records of files that are cut into byte ranges, against one reader of the whole."""

import json
import random

import pytest

from tidelog.sources import json_split
from tidelog.sources.json_logs import WRAPPERS, _records, flatten, read_json


def value(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 5)
    if kind < 3:
        return "".join(rng.choice('ab"\\{}[]:,\né\u2028😀 ') for _ in range(rng.randrange(12)))
    if kind < 5:
        return rng.choice([1, -2.5, True, None])
    if kind == 5:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"k{j}" + rng.choice(["", '"', "}", "[{"]): value(rng, depth + 1) for j in range(rng.randrange(4))}


def records(seed, n=60):
    rng = random.Random(seed)
    return [{"event_type": f"e{k}", "x": value(rng), "tags": [{"t": k}, {"t": -k}]} for k in range(n)]


FORMS = {
    "array": lambda rs: json.dumps(rs),
    "pretty": lambda rs: "\ufeff" + json.dumps(rs, indent=2, ensure_ascii=False),
    "one after another": lambda rs: "".join(json.dumps(r, ensure_ascii=False) for r in rs),
    "pretty, one after another": lambda rs: "\n\n".join(json.dumps(r, indent=1) for r in rs) + "\n",
    "wrapper": lambda rs: json.dumps({"meta": {"lists": [{"a": 1}] * 100}, "events": rs, "count": 3}),
    "nested wrapper": lambda rs: json.dumps({"Export": {"Event": rs}, "other": [{"b": 1}]}),
    "wrappers": lambda rs: json.dumps({"records": rs[:20]}) + "\n" + json.dumps(rs[20:40]) + json.dumps({"n": 1, "rows": rs[40:]}),
}


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("size, limit", [(211, 3000), (1500, 3000), (1 << 20, 1 << 20)])
def test_ranges_give_the_records_of_the_whole(spark, tmp_path, form, size, limit):
    if form == "nested wrapper" and size == 1 << 20:
        pytest.skip("a short object without a known list is a record itself")
    rs = records(size)
    (tmp_path / "f.json").write_text(FORMS[form](rs), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        got = json_split.split_json(spark, str(tmp_path), WRAPPERS, limit).orderBy("file", "line").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    out = []
    for r in got:
        out += [json.loads(r.text)] if r.kind == "item" else list(_records(r.text))
    assert [flatten(r) for r in out] == [flatten(r) for r in rs]


def test_read_json_numbers_records_by_their_place(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"events": records(1, 5)}))
    (tmp_path / "b.json").write_text("[]")
    (tmp_path / "c.json").write_text("")
    (tmp_path / "d.json").write_text('{"event_type": "x"} {"event_type": broken} {"event_type": "y"}')
    got = read_json(spark, str(tmp_path), whole=True).orderBy("file", "line").collect()
    assert [r.attrs["event_type"] for r in got] == ["e0", "e1", "e2", "e3", "e4", "x", "y"]
    assert len({(r.file, r.line) for r in got}) == 7


def test_long_object_without_records_is_an_error(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"a": {"b": "c" * 100}}))
    with pytest.raises(Exception, match="wraps no list"):
        json_split.split_json(spark, str(tmp_path), WRAPPERS, 50).collect()
