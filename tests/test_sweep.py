import random

from parlance.operators.sweep import asked, sweep


def plain(ids, witnesses, connected, said, refused, page):
    """A chat's sweep, page by page and witness by witness."""
    if not [w for w in witnesses if w in connected]:
        return "unreachable", [], 0
    if any(w not in connected for w in witnesses):
        return "remaining", [], 0
    if refused & set(witnesses):
        return ("held" if any((i, w) in said for i in ids for w in witnesses if w not in refused) else "remaining"), [], 0
    gone, checked = [], 0
    for at in range(0, len(ids), page):
        part = ids[at : at + page]
        if any(not any(said.get((i, w)) for w in witnesses) and any((i, w) not in said for w in witnesses) for i in part):
            return "remaining", gone, checked
        gone += [i for i in part if all(said.get((i, w)) is False for w in witnesses)]
        checked += len(part)
    return "done", gone, checked


def test_against_the_plain_rule(spark):
    rng = random.Random(9)
    messages, reach, answers, refusals, want = [], [], [], [], {}
    for chat in range(60):
        ids = sorted(rng.sample(range(1, 200), rng.randrange(1, 12)))
        witnesses = [a for a in "abcd" if rng.random() < (0.5 if a != "d" else 0.1)]
        refused = {a for a in witnesses if rng.random() < 0.1}
        share = rng.choice([1.0, 1.0, 0.95])
        said = {(i, a): rng.random() < 0.4 for i in ids for a in "abc" if a not in refused and rng.random() < share}
        messages += [(chat, i) for i in ids]
        reach += [(chat, a) for a in witnesses] * 2
        answers += [(chat, i, a, t) for (i, a), t in said.items()]
        refusals += [(chat, a) for a in refused]
        want[chat] = plain(ids, witnesses, set("abc"), said, refused, 4)
    m, r = spark.createDataFrame(messages, "chat_id long, msg_id long"), spark.createDataFrame(reach, "chat_id long, account string")
    a, f = spark.createDataFrame(answers, "chat_id long, msg_id long, account string, there boolean"), spark.createDataFrame(refusals, "chat_id long, account string")
    c = spark.createDataFrame([(x,) for x in "abc"], "account string")
    found = sweep(m, r, c, a, f, page=4)
    gone = {}
    for row in found.gone.collect():
        gone.setdefault(row.chat_id, []).append(row.msg_id)
    got = {row.chat_id: (row.outcome, sorted(gone.get(row.chat_id, [])), row.checked) for row in found.chats.collect()}
    assert got == want and {o for o, _, _ in want.values()} == {"done", "remaining", "held", "unreachable"}
    # the rest of a chat, from where it stopped
    after = {row.chat_id: row.after for row in found.chats.collect() if row.after is not None}
    again = sweep(m, r, c, a, f, spark.createDataFrame(list(after.items()), "chat_id long, after long"), page=4).chats.where("outcome = 'remaining' and checked > 0")
    assert again.count() == 0
    rows = {(x.chat_id, x.msg_id) for x in asked(m, r, a, "a").collect()}
    have, own = {(k, i) for k, i, _, t in answers if t}, {(k, i) for k, i, w, _ in answers if w == "a"}
    assert rows == {(k, i) for k, i in messages if (k, "a") in reach and (k, i) not in have | own}


def test_nothing_stored(spark):
    none = spark.createDataFrame([], "chat_id long, msg_id long, account string, there boolean")
    found = sweep(none, none, none, none, none)
    assert found.gone.count() == 0 and found.chats.count() == 0
