"""Decontamination, URL filters and preferences against brute force."""

import datetime
import random
import re

from estatemap.llm import decontaminate, preferences, urlfilter


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(text, items):
    own, hit, names = words(text), set(), set()
    for name, item in items:
        other = words(item)
        size = min(10, len(other))
        windows = {tuple(other[i:i + size]) for i in range(len(other) - size + 1)} if size else set()
        for start in range(len(own) - size + 1 if size else 0):
            if tuple(own[start:start + size]) in windows:
                hit.update(range(start, start + size))
                names.add("" if name is None else str(name))
    return len(own), len(hit), sorted(names)


def contamination_case():
    dealt = random.Random(3)
    vocabulary = ["the", "of", "Éa", "éa", "x1", "don't", *[f"w{i}" for i in range(30)]]
    item = lambda n: " ".join(dealt.choice(vocabulary) for _ in range(n))
    items = [(i, item(n)) for i, n in enumerate((0, 1, 4, 9, 10, 11, 25, 60))] + [(20, None), (None, "null named item here"), (6, "the the the the the the the the the the the")]
    items += items[3:5] + [(99, items[6][1])]
    docs = []
    for i in range(60):
        body = item(dealt.randrange(0, 80)).split()
        if i % 2:
            source = words(items[dealt.randrange(len(items))][1])
            at = dealt.randrange(len(body) + 1)
            body[at:at] = source[:dealt.randrange(1, 30)]
        docs.append((i, " ".join(body).upper() if i % 5 == 0 else ", ".join(body)))
    docs += [(70, None), (71, ""), (72, "the " * 3000), (None, items[7][1]), (None, items[7][1]), (3, docs[3][1])]
    return docs, items


def test_contamination(spark):
    docs, items = contamination_case()
    frame = spark.createDataFrame([(*d, "w", 0) for d in docs], "doc_id long, text string, window string, start int")
    bench = spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, item string")
    expected = []
    for key, text in docs:
        n, hit, names = brute_contamination(text, items)
        expected.append((str(key), n, hit, len(names), hit > 0))
    for block in (100_000, 7):
        hits = decontaminate.contamination(frame, bench, block=block)
        assert all(row.n_hit > 0 for row in hits.collect())
    found = decontaminate.contaminated_documents(frame, bench)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.contaminated) for r in found.collect()) == sorted(expected)
    kept = decontaminate.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(e[0] for e in expected if not e[4])


def test_blocks_change_nothing(spark):
    docs, items = contamination_case()
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(str, decontaminate.contamination(frame, bench, block=size).collect())) for size in (100_000, 9))
    assert one == many


def test_contamination_empty(spark):
    docs, items = contamination_case()
    no_docs, no_items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.contaminated_documents(no_docs, bench).count() == 0
    found = decontaminate.contaminated_documents(spark.createDataFrame(docs, "doc_id long, text string"), no_items).collect()
    assert len(found) == len(docs) and not any(row.contaminated for row in found)


def test_contamination_stays_in_the_jvm(spark):
    docs, items = contamination_case()
    found = decontaminate.contaminated_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().executedPlan().toString())


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(n)


def test_url_filter(spark):
    dealt = random.Random(9)
    domains = ["a.example.com", "example.com", "Example.com.", "b.example.com", "com", "other.org", None, ""]
    entries = [(dealt.choice(domains), dealt.choice(["ads", "ok", None]), dealt.choice(["add", "remove"]), dealt.choice([day(dealt.randrange(30)), None]))
               for _ in range(120)]
    entries += entries[:20]
    urls = ["http://a.example.com/x", "https://u:p@B.Example.com.:80/?q", "http://example.com", "ftp://x.a.example.com#f", "nothing", None, "http://other.org/a", "http://", "http://notexample.com/"]
    captures = [(i, urls[i % len(urls)], None if i % 11 == 0 else day(i % 37)) for i in range(150)] + [(None, urls[0], day(4)), (None, urls[0], day(4))]
    frame = spark.createDataFrame([(*c, 1) for c in captures], "id long, url string, fetched date, domain int")
    listed = spark.createDataFrame(entries, "domain string, list string, action string, time date")
    kinds = spark.createDataFrame([("ads", "block"), ("ok", "allow"), ("ok", "allow")], "list string, kind string")
    clean = lambda name: (name or "").lower().rstrip(".")

    def active(domain, name, at):
        state = False
        moments = sorted({e[3] for e in entries if clean(e[0]) == domain and e[1] == name and e[3] is not None and e[3] <= at})
        for moment in moments:
            state = any(e[2] == "add" for e in entries if clean(e[0]) == domain and e[1] == name and e[3] == moment)
        return state
    expected = []
    for key, url, at in captures:
        host = clean(re.sub(r"^.*@", "", match[1]).split(":")[0]) if (match := re.match(r"[a-z]+://([^/?#]*)", url or "")) else ""
        verdict = (None, None, False)
        labels = host.split(".")
        for up in range(len(labels) if host and at else 0):
            domain = ".".join(labels[up:])
            lists = sorted(name for name in ("ads", "ok") if active(domain, name, at))
            if lists:
                verdict = (domain, ",".join(lists), "ok" not in lists)
                break
        expected.append((str(key), host, *map(str, verdict)))
    found = urlfilter.evaluate(frame, listed, kinds).collect()
    assert sorted((str(r.id), r.host, str(r.domain), str(r.lists), str(r.blocked)) for r in found) == sorted(expected)
    assert urlfilter.evaluate(frame.limit(0), listed, kinds).count() == 0
    assert urlfilter.evaluate(frame, listed.limit(0), kinds).filter("blocked").count() == 0


def render(turns):
    return [f"<|{role or ''}|>\n{text or ''}<|end|>\n" for role, text in turns]


def test_preferences(spark):
    base = [("system", "S"), ("user", "Hi"), ("assistant", "Héllo"), ("user", None), ("assistant", "")]
    cases = {
        1: (base, base), 2: (base, base[:2] + [("assistant", "Other"), ("user", "x")]), 3: (base, []), 4: ([("user", "a")], [("user", "b")]),
        5: (base, base + [("assistant", "more " * 5000)]), 6: ([(None, "n")], [("", "n")]),
    }
    rows = [(pair, side, turn, role, text, "extra", 9) for pair, sides in cases.items() for side, turns in zip(("chosen", "rejected"), sides)
            for turn, (role, text) in enumerate(turns)]
    rows += [(None, "chosen", 0, "user", "x", "", 0), (7, "other", 0, "user", "x", "", 0), (7, "chosen", None, "user", "x", "", 0)]
    frame = spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string, part string, start int")
    for bucket in (1000, 2):
        found = {}
        for row in preferences.preference_rows(frame, bucket).collect():
            found.setdefault((row.pair_id, row.part), []).append(row)
        for pair, (chosen, rejected) in cases.items():
            left, right = render(chosen), render(rejected)
            shared = next((i for i, (a, b) in enumerate(zip(left, right)) if a != b), min(len(left), len(right)))
            for part, expected, roles in (("prompt", left[:shared], chosen[:shared]), ("chosen", left[shared:], chosen[shared:]), ("rejected", right[shared:], rejected[shared:])):
                own = sorted(found.pop((pair, part), []), key=lambda row: row.start)
                assert [row.rendered for row in own] == expected
                whole = "".join(expected)
                for row, (role, text) in zip(own, roles):
                    assert whole[row.start:row.start + len(row.rendered)] == row.rendered
                    learned = part != "prompt" and role == "assistant"
                    assert (whole[row.train_from:row.train_to] if learned else None) == (f"{text or ''}<|end|>" if learned else row.train_from)
        assert not found
    assert preferences.preference_rows(frame.limit(0)).count() == 0
    assert not re.search("Python|Pandas|Arrow", preferences.preference_rows(frame)._jdf.queryExecution().executedPlan().toString())


def test_preferences_with_repeated_turns(spark):
    rows = [(1, "chosen", 0, "user", "a"), (1, "chosen", 0, "user", "a"), (1, "rejected", 0, "user", "a"), (2, "chosen", 0, "b", "x"), (2, "chosen", 0, "a", "y"),
            (2, "rejected", 0, "a", "y"), (2, "rejected", 0, "b", "x")]
    found = preferences.preference_rows(spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string")).collect()
    assert sorted((r.pair_id, r.part, r.place, r.role) for r in found) == [
        (1, "chosen", 0, "user"), (1, "chosen", 1, "user"), (1, "rejected", 0, "user"), (2, "prompt", 0, "a"), (2, "prompt", 1, "b")]
