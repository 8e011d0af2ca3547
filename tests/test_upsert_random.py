"""upsert_users on batches built around planned winners: each key's first
place and last writer are chosen first, the rows around them after."""

import random

from retentio.operators.ingest import upsert_users


def test_upsert_keeps_the_planned_winner_at_the_first_place(spark):
    rng = random.Random(11)
    slots = {0: list(range(200)), 1: list(range(200))}  # free positions per batch
    for s in slots.values():
        rng.shuffle(s)
    rows, want = {0: [], 1: []}, {}
    for k in range(70):
        key = f"u{k}"
        places = sorted((b, slots[b].pop()) for b in (rng.choice([0, 1]) for _ in range(rng.randint(1, 4))))
        for b, pos in places:
            rows[b].append((rng.choice([key, key.upper()]), f"{b}-{pos}", pos))
        want[places[0]] = f"{places[-1][0]}-{places[-1][1]}"
    for b in rows:
        rows[b] += [(rng.choice([None, ""]), "nobody", slots[b].pop()) for _ in range(8)]
        rng.shuffle(rows[b])
    sch = "login string, v string, pos int"
    got = upsert_users(spark.createDataFrame(rows[0], sch), spark.createDataFrame(rows[1], sch)).collect()
    assert {(r.first_batch, r.first_pos): r.v for r in got} == want
