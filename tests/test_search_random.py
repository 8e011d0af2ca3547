"""search_logins on page sets built around a planned stop: what must come out
is known from the plan, not computed from the pages."""

import json
import random

from retentio.sources.raw import read_search_pages
from retentio.sources.usernames import search_logins

SIZE = 20


def planned(rng, query):
    """Pages of one query and the (login, page, pos) that must come out.

    ``last`` pages are read; then one of five things ends the reading, and
    pages behind it hold names that must not appear."""
    last = rng.randint(1, 9)
    end = rng.choice(["missing", "empty", "short", "total", "none"])
    pages, out, names = [], [], 0
    for page in range(1, last + 1):
        n = rng.randint(1, SIZE - 1) if end == "short" and page == last else SIZE
        items = []
        for pos in range(n):
            fresh = rng.random() < 0.7 or not out
            if rng.random() < 0.05:
                items.append({"login": None})
            elif fresh:
                login = rng.choice([str.upper, str.lower, str.capitalize])(f"{query}n{names}")
                names += 1
                items.append({"login": login})
                out.append((login, page, pos))
            else:  # a name from before, spelled anew
                items.append({"login": rng.choice(out)[0].swapcase()})
        pages.append([page, items])
    total = 10**6
    if end == "total":
        before = sum(1 for _, page, _ in out if page < last)
        total = rng.randint(before + 1, len(out)) if len(out) > before else 10**6
        end = "total" if len(out) > before else "none"
    if end == "empty":
        pages.append([last + 1, []])
    if end != "none":
        first = last + (2 if end in ("missing", "empty") else 1)
        for page in range(first, first + 2):
            pages.append([page, [{"login": f"{query}unread{page}-{k}"} for k in range(SIZE)]])
    return [{"query": query, "page": p, "total_count": total, "items": items} for p, items in pages], out


def test_search_logins_follows_the_plan(spark, tmp_path):
    rng = random.Random(7)
    pages, want = [], {}
    for q in range(60):
        made, want[f"q{q}"] = planned(rng, f"q{q}")
        pages += made
    rng.shuffle(pages)
    path = tmp_path / "pages.json"
    path.write_text("\n".join(json.dumps(p) for p in pages))
    got = {}
    for r in search_logins(read_search_pages(spark, str(path)), per_page=SIZE).collect():
        got.setdefault(r.query, []).append((r.login, r.page, r.pos))
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()}


def test_a_callers_page_limit(spark, tmp_path):
    pages = [{"query": "q", "page": p, "total_count": 999, "items": [{"login": f"u{p}-{k}"} for k in range(3)]} for p in range(1, 8)]
    path = tmp_path / "pages.json"
    path.write_text("\n".join(json.dumps(p) for p in pages))
    df = read_search_pages(spark, str(path))
    assert search_logins(df, per_page=3).count() == 21
    assert search_logins(df, per_page=3, max_pages=2).count() == 6
