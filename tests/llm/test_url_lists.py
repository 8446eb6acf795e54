import datetime as dt

import pytest

from shardwright.llm import url_lists as U

D = dt.date
ENTRIES = "list_name string, key string, allow boolean, day date, action string"
CAPTURES = "page_id long, url string, fetch_date date"


def judge(make, captures, entries, **options):
    out = U.temporal_join(make(captures, CAPTURES), make(entries, ENTRIES, extra=False), **options)
    return out, sorted(((r["page_id"], r["blocked"], r["list_name"], r["list_key"], r["active_since"], r["n_active"]) for r in out.collect()), key=str)


def brute(captures, entries):
    """Replays every list day by day for each capture."""
    out = []
    for i, url, day in captures:
        ks = []
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = rest.split("/")[0].split("@")[-1].split(":")[0].split("?")[0].split("#")[0].lower()
            for lead in ("www.", "m.", "blog."):
                if host.startswith(lead):
                    host = host[len(lead):]
                    break
            path = rest.split("/")[1:]
            labels = host.split(".")
            ks = [".".join(labels[k:]) for k in range(max(1, len(labels) - 1))] if host else []
            if host and len(path) > 1 and path[0]:
                ks.append(f"{host}/{path[0]}")
        hits = []
        for name, key, allow in {(e[0], e[1], e[2]) for e in entries if e[1]}:
            on, since = False, None
            for _, _, _, at, action in sorted((e for e in entries if e[:3] == (name, key, allow) and e[3] and e[4]), key=lambda e: (e[3], e[4])):
                if day and at <= day:
                    on, since = action == "add", at
            if on and key in ks:
                hits.append((len(key), int(allow), key, name, since))
        if hits:
            _, a, key, name, since = max(hits)
            out.append((i, a == 0, name, key, since, len(hits)))
        else:
            out.append((i, False, None, None, None, 0))
    return sorted(out, key=str)


def test_lists_as_of_the_day_of_the_fetch(make):
    entries = [("spam", "bad.example.com", False, D(2023, 1, 10), "add"), ("spam", "bad.example.com", False, D(2023, 2, 10), "remove"),
               ("spam", "bad.example.com", False, D(2023, 6, 1), "add"), ("ok", "bad.example.com/docs", True, D(2023, 1, 1), "add"),
               ("tld", "example.com", False, D(2023, 7, 1), "add"), ("tld", "example.com", False, D(2023, 7, 1), "remove"),
               ("x", None, False, D(2023, 1, 1), "add"), ("x", "a.b", False, None, "add"), ("x", "a.b", False, D(2020, 1, 1), None)]
    days = [D(2023, 1, 9), D(2023, 1, 10), D(2023, 2, 9), D(2023, 2, 10), D(2023, 7, 1), D(2023, 12, 31), None]
    urls = ["http://www.bad.example.com/x/1", "https://bad.example.com/docs/y", "http://u:p@BAD.example.com:80/z", "http://other.example.com", "nonsense", "", None, "http://a.b/c"]
    captures = [(k, u, d) for k, (u, d) in enumerate((u, d) for u in urls for d in days)]
    captures += [(0, urls[0], days[1])] * 2                      # a repeated row keeps both rows
    out, got = judge(make, captures, entries)
    assert got == brute(captures, entries)
    assert set(out.columns) == {"page_id", "url", "fetch_date", "shard", "epoch", *U.RESULT}


@pytest.mark.parametrize("captures,entries", [([], [("a", "b.c", False, D(2023, 1, 1), "add")]), ([(1, "http://b.c/", D(2023, 1, 1))], [])])
def test_empty_tables(make, captures, entries):
    assert judge(make, captures, entries)[1] == brute(captures, entries)


def test_hot_site_with_a_long_history(make):
    entries = [("daily", "hot.example.org", False, D(2022, 1, 1) + dt.timedelta(days=k), ("add", "remove")[k % 2]) for k in range(400)]
    captures = [(k, "http://hot.example.org/p", D(2022, 1, 1) + dt.timedelta(days=k % 450)) for k in range(900)]
    out, got = judge(make, captures, entries)
    assert got == brute(captures, entries)


@pytest.mark.parametrize("salt_rows", [1, 10, 60])
def test_only_hot_keys_are_dealt(make, salt_rows):
    entries = [("old", "hot.example.org", False, D(1990, 1, 1), "add"), ("old", "cold.example.com", False, D(1990, 1, 1), "add"),
               ("new", "hot.example.org", False, D(2022, 1, 20), "add"), ("new", "hot.example.org", False, D(2030, 1, 1), "remove"),
               ("late", "example.org", False, D(2040, 1, 1), "add"), ("past", "example.org", False, D(1980, 1, 1), "add"),
               ("past", "example.org", False, D(1981, 1, 1), "remove")]
    captures = [(k, "http://hot.example.org/p", D(2022, 1, 1) + dt.timedelta(days=k % 40)) for k in range(200)]
    captures += [(1000 + k, "http://cold.example.com/q", D(2022, 1, 1) + dt.timedelta(days=9 * k)) for k in range(5)] + [(0, "http://hot.example.org/p", None)]
    out, got = judge(make, captures, entries, salt_rows=salt_rows)
    assert got == brute(captures, entries)
