import random

from parlance.operators import units
from parlance.operators.climb import chains

ROWS = "chat_id long, msg_id long, reply_to_msg_id long"


def test_against_all_roots(spark):
    """Trees, chains longer than the levels, cycles, missing parents, messages that answer themselves."""
    rng = random.Random(2)
    rows = [(1, i, rng.choice([None, *range(max(1, i - 9), i)]) if i > 1 else None) for i in range(1, 80)]
    rows += [(2, i, i - 1) for i in range(1, 40)] + [(3, 1, 2), (3, 2, 1), (3, 3, 2), (3, 4, 4), (3, 5, 4), (3, 6, 99), (3, 7, 6)]
    m = spark.createDataFrame(rows, ROWS)
    ids = [(1, 40), (1, 77), (2, 20), (3, 3), (3, 5), (3, 7), (3, 50)]
    roots = {(r.chat_id, r.msg_id): r.root for r in units.reply_roots(m).collect()}
    for levels in (3, 24):
        for part in (ids, [(1, 40), (3, 5)], [(3, 50)], []):
            tops = {(c, roots[c, i]) for c, i in part if (c, i) in roots}
            want = {(c, i, r) for (c, i), r in roots.items() if (c, r) in tops}
            got = [tuple(r) for r in chains(m, spark.createDataFrame(part, "chat_id long, msg_id long"), levels).select("chat_id", "msg_id", "root").collect()]
            assert set(got) == want and len(got) == len(want)
