import random

from pyspark.sql import functions as F

from vozmark.llm import chat_format, common, decontamination, url_filter

ITEM = "If Anna walks 12 km in 3 hours and then rests for 45 minutes how far does she get per hour"
BENCH = [(1, ITEM), (2, "short item here"), (3, None), (4, ""), (1, ITEM)]


def leaks(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = decontamination.find_leaks(docs, bench).collect()
    return {(r["doc_id"], r["item_id"]): (r["doc_start"], r["n_words"], r["reworded"]) for r in got}


def test_leaks_copies_rewordings_and_clean_texts(spark):
    other = ITEM.replace("Anna", "Boris").replace("12", "30").replace("45", "20").replace("3 hours", "7 hours")
    mixed = ITEM.replace("12 km in 3 hours", "12 km in 12 hours")
    texts = {
        1: f"Some words before. {ITEM}. And after",
        2: f"x {other}?",
        3: f"y {mixed}",
        4: "nothing of the kind is said in this text at all",
        5: None,
        6: "",
        7: "a short, item here b",
        8: " ".join(ITEM.split()[:8]),
    }
    got = leaks(spark, texts)
    assert got[1, 1] == (3, 21, False) and got[2, 1] == (1, 21, True)
    # One value of the text for two of the item is no consistent rewording.
    assert (3, 1) not in got
    assert (7, 2) in got and set(got) == {(1, 1), (2, 1), (7, 2)}


def test_leaks_in_other_case(spark):
    bench = [(1, ITEM), (2, "Der Fuß ist groß"), (3, "Paul mixed 5 ml of it")]
    other = ITEM.replace("12", "30").replace("45", "20").replace("3 hours", "7 hours")
    texts = {
        1: f"Before it. {ITEM.upper()} AND MORE",
        2: f"x {ITEM.lower()} y",
        3: ITEM.title(),
        4: other.upper(),
        5: "so: DER FUSS IST GROSS.",
        6: "paul mixed 5 mL of it",
        7: "EVERY WORD OF THIS TEXT STANDS IN CAPITALS BUT IT IS NO COPY OF ANY ITEM AT ALL",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = decontamination.find_leaks(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): (r["doc_start"], r["n_words"], r["reworded"]) for r in got}
    assert got == {
        (1, 1): (2, 21, False),
        (2, 1): (1, 21, False),
        (3, 1): (0, 21, False),
        (4, 1): (0, 21, True),
        (5, 2): (1, 4, False),
        (6, 3): (0, 6, False),
    }


def test_leaks_next_to_words_of_the_text(spark):
    item = (
        "The river that runs by 12 mills turns north. De Vries saw it rise over the old wall. "
        "The town then built 30 new boats and sold them all to De Jong before winter came."
    )
    words = item.split()
    texts = {
        # The copy goes on with a capital word, or a number, for which the item has another.
        1: " ".join(words[:17]) + " To others it was nothing",
        2: " ".join(words[:20]) + " 12 boats of them",
        # So it does before its start: the item has The for De, and 12 for 30.
        3: "nobody knew. De " + " ".join(words[18:]),
        4: "it took 30 " + " ".join(words[6:]),
        # A run of fewer words stays too short when shrunk.
        5: " ".join(words[5:17]) + " North others",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = decontamination.find_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    got = {r["doc_id"]: (r["doc_start"], r["item_start"], r["n_words"], r["reworded"]) for r in got}
    assert got == {
        1: (0, 0, 17, False),
        2: (0, 0, 20, False),
        3: (3, 18, 17, False),
        4: (3, 6, 29, False),
    }


def brute_leaks(texts, items):
    """{(doc_id, item_id): n_words} by the rules alone: every shift, every run, both forms, every window."""
    import re

    units = set(decontamination.UNITS.split())

    def bare(w):
        return re.sub(r"^[\W_]+|[^\w%]+$", "", w)

    def forms(w):
        b = bare(w)
        if re.fullmatch(r"[a-z]+", b):
            t = "<unit>" if b in units else b
        elif re.fullmatch(r"[0-9][0-9.,:/%]*", b):
            t = "<number>"
        elif re.fullmatch(r"[0-9][0-9.,:/]*[^\W\d_]+", b):
            t = "<quantity>"
        elif re.fullmatch(r"[A-Z][A-Za-z'-]*", b):
            t = "<name>"
        else:
            t = b.lower()
        c = ("<unit>" if b.lower() in units else b.lower()) if t == "<name>" else "<unit>" if t in units else t
        return t, c, b.lower()

    def met(a, b):
        """Windows of eight (or all) that are equal: by form if rich, else by bare words."""
        n = len(b)
        for k in (0, 1):
            rich = sum(not x[k].startswith("<") for x in b) >= min(3, n)
            if [x[k] for x in a] == [x[k] for x in b] if rich else [x[2] for x in a] == [x[2] for x in b]:
                return True
        return False

    def consistent(slots):
        clash = lambda x, y: x[0] == y[0] and (x[1] == y[1]) != (x[2] == y[2])
        return not any(clash(x, y) for i, x in enumerate(slots) for y in slots[:i])

    out = {}
    for d, text in texts.items():
        doc = [forms(w) for w in text.split()]
        for i, item in items.items():
            it = [forms(w) for w in item.split()]
            n, w = len(it), min(8, len(it))
            for shift in range(1 - n, len(doc)):
                eq = [0 <= j + shift < len(doc) and (it[j][0] == doc[j + shift][0] or it[j][1] == doc[j + shift][1]) for j in range(n)]
                j = 0
                while j < n:
                    if not eq[j]:
                        j += 1
                        continue
                    z = j
                    while z < n and eq[z]:
                        z += 1
                    run = [(it[k], doc[k + shift]) for k in range(j, z)]
                    if z - j >= min(13, n) and any(met([x[1] for x in run[k : k + w]], [x[0] for x in run[k : k + w]]) for k in range(z - j - w + 1)):
                        kinds = [(b[0] if b[0] == a[0] else b[1], b[2], a[2]) for b, a in run]
                        slots = [x for x in kinds if x[0].startswith("<")]
                        if consistent(slots) and sum(x[1] == x[2] for x in kinds) >= min(5, n):
                            out[d, i] = max(out.get((d, i), 0), z - j)
                    j = z
    return out


def test_leaks_equal_brute_force(spark):
    """Small vocabularies, so that windows meet by chance; changed values, changed case, numbers."""
    rng = random.Random(9)
    plain = ["red", "blue", "goes", "stands", "under", "between", "mill", "river", "then", "costs"]
    slot = lambda: rng.choice(["12", "30", "45", "7", "km", "hours", "Anna", "Boris", "5kg", "9kg"])
    word = lambda p: slot() if rng.random() < p else rng.choice(plain)
    items = {i: " ".join(word(rng.choice([0.1, 0.3, 0.6])) for _ in range(rng.choice([4, 9, 16, 30]))) for i in range(25)}
    items[90] = " ".join(str(rng.randrange(100)) for _ in range(20))
    texts = {}
    for d in range(60):
        words = [word(0.2) for _ in range(rng.randrange(20))]
        copy = items[rng.choice(list(items))].split()
        if rng.random() < 0.5:
            swap = {"12": "30", "30": "12", "Anna": "Boris", "km": "hours"}
            copy = [swap.get(w, w) for w in copy] if rng.random() < 0.5 else copy[rng.randrange(3) :]
        texts[d] = " ".join(words + copy + [word(0.2) for _ in range(rng.randrange(9))])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = decontamination.find_leaks(docs, spark.createDataFrame(list(items.items()), "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["n_words"] for r in got.collect()}
    want = brute_leaks(texts, items)
    assert want and {k: got.get(k) for k in want} == want
    # What else is found are consistent parts of inconsistent runs.
    assert all(k[0] in texts and n >= 4 for k, n in got.items())


def test_numbers_alone_do_not_meet_other_numbers(spark):
    """20 items of 40 numbers, a text of 20,000 numbers and a copy among them."""
    rng = random.Random(1)
    numbers = lambda n: " ".join(str(rng.randrange(1000)) for _ in range(n))
    items = [(i, numbers(40)) for i in range(20)]
    docs = [(1, numbers(20_000)), (2, f"{numbers(5000)} {items[3][1]} {numbers(5000)}")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontamination.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["n_words"], r["reworded"]) for r in got] == [(2, 3, 40, False)]


def test_many_items_are_joined_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "MAX_ITEM_WORDS", 0)
    monkeypatch.setattr(common, "MAX_BROADCAST", 0)
    test_leaks_copies_rewordings_and_clean_texts(spark)


def test_leaks_edge_cases(spark, documents):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert decontamination.find_leaks(documents, bench).count() == 0
    assert decontamination.find_leaks(documents, bench.limit(0)).count() == 0
    assert decontamination.drop_leaks(documents, bench).columns == documents.columns
    assert decontamination.drop_leaks(documents, bench).count() == 8
    assert decontamination.drop_leaks(documents.limit(0), bench).count() == 0


def test_rules_hosts_and_paths(spark):
    cases = {
        "http://a.com/en/1": ("a.com", "/en/1", "com/en/", "block"),
        "http://WWW.Example.COM/en/7?x": ("www.example.com", "/en/7", "example.com/en/7", "allow"),
        "https://x.example.net/de/8#y": ("x.example.net", "/de/8", "example.net/de/8", "block"),
        "https://net/de/": ("net", "/de/", "net/de/", "allow"),
        "https://fakenet/de/": ("fakenet", "/de/", None, "allow"),
        "no url": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://a.org?/es/": ("a.org", "", None, "allow"),
        "x://b.org/es/://c": ("b.org", "/es/://c", "org/es/", "block"),
    }
    rows = [(i, u, None) for i, u in enumerate(cases)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in url_filter.filter_urls(df).collect()}
    assert got == {i: v[:3] for i, v in enumerate(cases.values())}
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_trust_and_distrust_equal_power_iteration(spark):
    links = [("a", "b", 2), ("a", "c", 1), ("b", "d", 1), ("e", "d", 1), ("d", "f", 3)]
    seeds = [("a", 3.0, 0.0), ("g", 1.0, 0.0), ("f", 0.0, 2.0)]
    hosts = sorted({h for s, d, _ in links for h in (s, d)} | {s[0] for s in seeds})

    def rank(edges, seed):
        total = sum(seed.values())
        base = {h: seed.get(h, 0) / total for h in hosts}
        r = dict(base)
        out = {}
        for s, _, n in edges:
            out[s] = out.get(s, 0) + n
        for _ in range(200):
            lost = sum(x for h, x in r.items() if h not in out)
            new = {h: (0.15 + 0.85 * lost) * base[h] for h in hosts}
            for s, d, n in edges:
                new[d] += 0.85 * r[s] * n / out[s]
            r = new
        return r

    trust = rank(links, {"a": 3, "g": 1})
    distrust = rank([(d, s, n) for s, d, n in links], {"f": 2})
    got = url_filter.propagate(
        spark.createDataFrame(seeds, "host string, trust double, distrust double"),
        spark.createDataFrame(links, "src string, dst string, n long"),
    ).collect()
    assert len(got) == len(hosts)
    for r in got:
        assert abs(r["trust"] - trust[r["host"]]) < 1e-3 and abs(r["distrust"] - distrust[r["host"]]) < 1e-3


def test_chain_of_sixty_links_equals_power_iteration(spark):
    hosts = [f"h{i:02d}" for i in range(61)]
    links = [(a, b, 1) for a, b in zip(hosts, hosts[1:], strict=False)]
    seeds = [("h00", 1.0, 0.0), ("h60", 0.0, 1.0)]
    got = url_filter.propagate(
        spark.createDataFrame(seeds, "host string, trust double, distrust double"),
        spark.createDataFrame(links, "src string, dst string, n long"),
    ).collect()
    trust = [1.0] + [0.0] * 60
    for _ in range(400):
        trust = [0.15 + 0.85 * trust[-1], *[0.85 * x for x in trust[:-1]]]
    for r in got:
        i = int(r["host"][1:])
        assert abs(r["trust"] - trust[i]) < 2e-6 and abs(r["distrust"] - trust[60 - i]) < 2e-6
        assert r["trust"] > 0 and r["distrust"] > 0


def test_verdicts_of_linked_hosts_by_loop(spark, monkeypatch):
    """Pages of random hosts with links, a hub among them: verdicts against scores worked out here."""
    monkeypatch.setattr(url_filter, "HOT_ROWS", 10)
    rng = random.Random(8)
    hosts = [f"a{i}.com" for i in range(15)] + [f"b{i}.net" for i in range(15)] + [f"c{i}.org" for i in range(15)]
    pages = []
    for i in range(300):
        host = rng.choice(hosts)
        path = rng.choice(["/en/", "/de/", "/es/", "/fr/"])
        targets = rng.sample(hosts, 40 if host == "a0.com" else 2)
        html = "".join(f'<a href="http://{t}/x">t</a>' for t in targets)
        pages.append((i, f"http://{host}{path}{i}", html))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(df).collect()}
    by = {}
    for i, url, _ in pages:
        host, path = url[7:].split("/", 1)
        rule = {("com", "en"): "block", ("net", "de"): "allow", ("org", "es"): "block"}.get((host[-3:], path[:2]))
        by.setdefault(host, []).append((i, rule))
    edges = {}
    for _, url, html in pages:
        src = url[7:].split("/")[0]
        for t in {x.split("/")[0] for x in html.split("http://")[1:]} - {src}:
            edges[src, t] = edges.get((src, t), 0) + 1
    n, seeds = {h: len(v) for h, v in by.items()}, ({}, {})
    for h, v in by.items():
        a, b = (sum(r == k for _, r in v) for k in ("allow", "block"))
        if b >= 0.5 * n[h]:
            seeds[1][h] = b
        elif a >= 0.1 * n[h]:
            seeds[0][h] = a
    ranks = []
    for seed, links in zip(seeds, (edges, {(d, s): k for (s, d), k in edges.items()}), strict=True):
        out, total = {}, sum(seed.values())
        for (s, _), k in links.items():
            out[s] = out.get(s, 0) + k
        r = {h: seed.get(h, 0) / total for h in hosts}
        for _ in range(300):
            lost = sum(x for h, x in r.items() if h not in out)
            new = {h: (0.15 + 0.85 * lost) * seed.get(h, 0) / total for h in hosts}
            for (s, d), k in links.items():
                new[d] += 0.85 * r[s] * k / out[s]
            r = new
        ranks.append(r)
    verdicts = set()
    for h, v in by.items():
        for i, rule in v:
            assert abs(got[i]["trust"] - ranks[0][h]) < 1e-5 and abs(got[i]["distrust"] - ranks[1][h]) < 1e-5
            want = rule or ("block" if ranks[1][h] > ranks[0][h] else "allow")
            if rule or abs(ranks[1][h] - ranks[0][h]) > 1e-5:
                assert got[i]["verdict"] == want
                verdicts.add((rule is None, want))
    assert len(verdicts) == 4


def test_links_of_pages(spark):
    html = '<p>//no.com/</p><A class=x HREF="http://B.com/1">x</a><a href=\'//c.net\'>y</a><a href="/own">z</a><a href="https://a.com/q">s</a>'
    df = spark.createDataFrame([(1, "http://a.com/x", html), (2, None, html), (3, "http://a.com/y", None)], "page_id long, url string, html string")
    got = {(r["src"], r["dst"], r["n"]) for r in url_filter.host_links(df).collect()}
    assert got == {("a.com", "b.com", 1), ("a.com", "c.net", 1)}


def test_calls_and_results(spark):
    call = lambda s: f"<tool_call>{s}</tool_call>"
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", "ok " + call('{"name":"fetch","id":"b","arguments":{"url":"$ref:a"}}') + call('{"id":"a","name":"search","arguments":{"query":"x","limit":"3"}}')),
        (1, 2, "tool", '<tool_result>{"id":"a","content":{"z":1,"b":[1, 2]}}</tool_result>'),
        (1, 3, "assistant", call('{"id":"a","name":"search"}') + call("nope") + call('{"id":"c","name":"fetch","arguments":{"url":"$ref:d"}}') + call('{"id":"d","name":"fetch","arguments":{"url":"$ref:c"}}')),
        (2, 0, None, None),
        (None, 0, "tool", '<tool_result>{"id":"a"}</tool_result>'),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit("clash"))
    got = {(r["conv_id"], r["turn"], r["part"]): r for r in chat_format.format_chats(df).collect()}
    assert len(got) == 14
    assert (got[1, 1, 2]["level"], got[1, 1, 2]["status"], got[1, 1, 2]["errors"]) == (0, "invalid", "type:limit")
    assert (got[1, 1, 1]["level"], got[1, 1, 1]["status"]) == (1, "no_result")
    assert got[1, 2, 1]["json"] == '{"content":{"b":[1,2],"z":1},"id":"a"}' and got[1, 2, 1]["status"] == "ok"
    assert got[1, 3, 1]["status"] == "duplicate_id" and got[1, 3, 2]["status"] == "malformed"
    assert got[1, 3, 3]["status"] == got[1, 3, 4]["status"] == "cycle"
    assert got[None, 0, 1]["status"] == "no_call" and got[2, 0, 0]["json"] == '{"content":"","role":""}'
    assert got[1, 1, 1]["json"] == '{"arguments":{"url":"$ref:a"},"id":"b","name":"fetch"}'
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_levels_of_chains_trees_and_cycles_by_loop(spark):
    """Random references in conversations: levels, cycles and lost references against a loop; ties,
    repeated rows and one hot id."""
    rng = random.Random(6)
    rows, refs = [], {}
    for conv in range(12):
        ids = [f"k{i}" for i in range(rng.randrange(1, 14))]
        for turn, i in enumerate(ids):
            earlier = [f"k{j}" for j in range(turn)]
            need = rng.sample(earlier, min(len(earlier), rng.randrange(3)))
            if conv == 3 and turn:
                need = [ids[turn - 1]]
            if conv % 4 == 1 and turn == 0 and len(ids) > 2:
                need = [ids[-1]]
            if conv % 5 == 2 and rng.random() < 0.2:
                need.append("nowhere")
            refs[conv, i] = need
            args = ",".join(f'"q{n}":"$ref:{r}"' for n, r in enumerate(need))
            rows.append((conv, turn, "assistant", f'<tool_call>{{"id":"{i}","name":"fetch","arguments":{{{args}}}}}</tool_call>'))
    rows += [rows[0], rows[0]]

    def level(conv, i, on=()):
        if i in on:
            return None
        below = [level(conv, r, (*on, i)) for r in refs[conv, i] if (conv, r) in refs]
        return None if None in below else 1 + max(below, default=-1)

    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_format.format_chats(df).where("kind = 'call'").collect()
    assert len(got) == len(rows)
    again = [r for r in got if r["status"] == "duplicate_id"]
    assert len(again) == 2
    for r in got:
        if r["status"] == "duplicate_id":
            continue
        want = level(r["conv_id"], r["call_id"])
        assert r["level"] == (-1 if want is None else want), (r["conv_id"], r["call_id"])
        lost = any((r["conv_id"], x) not in refs for x in refs[r["conv_id"], r["call_id"]])
        assert (r["status"] == "missing_reference") == lost
        assert (r["status"] == "cycle") == (want is None and not lost)


def test_very_long_and_odd_messages(spark):
    text = "x " * 200_000 + '<tool_call>{"id":"a","name":"search","arguments":{"query":"' + "y" * 100_000 + '"}}</tool_call>'
    rows = [(1, 0, "assistant", text), (1, None, None, None), (None, None, None, "")]
    got = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 4 and [r["status"] for r in got if r["kind"] == "call"] == ["no_result"]
