import json
import random

import pytest

from parlance.sources import export
from parlance.sources.large_export import Shape, read_large


def rows(df):
    return sorted((tuple(r)[1:] for r in df.collect()), key=repr)


def account(n):
    """An export of several chats, with strings that hold brackets, quotes, commas and escapes, and other sections before and after."""
    rng = random.Random(n)

    def message(i):
        text = rng.choice(['plain, with "quotes"', "]}{[ \\\\", 'a\\"],{', "", "ünïcode\n, tab\t", {"type": "link", "text": "[,]"}])
        m = {"id": i, "type": "message", "date_unixtime": str(1_700_000_000 + i), "from": "Ann, the \"first\"", "from_id": "user5", "text": text if isinstance(text, str) else ["see ", text, "\\"]}
        if i % 3 == 0:
            m["reactions"] = [{"type": "emoji", "count": 2}, {"type": "emoji", "count": i}]
        return m

    chats = [{"name": f"Room, {c} }}", "type": "private_group" if c % 3 else "no_such", "id": c + 1, "messages": [message(i) for i in range(rng.randrange(0, 9))]} for c in range(n)]
    chats[1]["messages"][1:1] = [7, "no object"]
    chats[2]["messages"] = "none"
    return {"about": "x, {", "contacts": {"list": [{"a": {"b": {"c": {"d": 1}}}}]}, "chats": {"about": "[", "list": [*chats, 5]}, "left_chats": {"list": chats[:2]}, "sessions": []}


@pytest.fixture
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def choose(size):
        for n in names:
            spark.conf.set(n, str(size))

    yield choose
    for n, b in zip(names, before, strict=True):
        spark.conf.set(n, b)


@pytest.mark.parametrize(("size", "indent"), [(97, None), (400, 1)])
def test_by_ranges_as_by_one_task(spark, tmp_path, small_ranges, size, indent):
    """Ranges shorter and longer than a message, in one line and in many; an account's export and a chat's."""
    small_ranges(size)
    whole = account(8)
    for name, data in (("a.json", whole), ("b.json", whole["chats"]["list"][4]), ("c.json", {"neither": [1, {}]}), ("d.json", [1])):
        path = tmp_path / name
        path.write_text(json.dumps(data, indent=indent, ensure_ascii=False))
        assert rows(read_large(spark, str(path))) == rows(export.read_entries(spark, str(path)))


def test_cut_files(spark, tmp_path, small_ranges):
    """Cut in a string, after a backslash, within a message that has something whole, between messages, in a chat's head."""
    small_ranges(150)
    text = json.dumps(account(4))
    at = text.index('"chats"')
    cuts = [text.index("\\\\", at) + 1, text.index('"count"', at) + 5, text.index("}, {", text.index('"messages"', at)) + 2, text.index('"Room, 1') + 3, len(text) - 40]
    for k, end in enumerate(cuts):
        path = tmp_path / f"cut{k}.json"
        path.write_text(text[:end])
        assert rows(read_large(spark, str(path))) == rows(export.read_entries(spark, str(path))), end


def test_shapes_compose():
    """Where a text begins follows from the shapes of what lies before it, however it is cut at commas."""
    text = json.dumps(account(5))
    parts, stack, inside = text.split(","), "", False
    whole = Shape(False)
    for part in parts:
        both = Shape(False), Shape(True)
        for x in both:
            x.feed(part + ",")
        own = both[inside]
        stack, inside = stack[: max(0, len(stack) - own.closed)] + "".join(own.open), own.inside
        whole.feed(part + ",")
        assert (stack, inside) == ("".join(whole.open), whole.inside)
    assert (stack, inside, whole.closed) == ("", False, 0)
