"""HTML extraction, fill-in-middle and conversation repair against plain versions."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

# ---------------------------------------------------------------- fill-in-middle


def plain_middle(doc_id, text, unit=r"[^\n]*\n|[^\n]+", percent=100, spm=50, seed="7"):
    text = text or ""
    units = re.findall(unit, text)
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return (doc_id, n, "plain", None, None, text)
    if h[3] % 100 < spm:
        return (doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


TEXTS = [None, "", "\n", "\n\n\n", "one", "one\n", "a\nb\nc", "a\r\nb\x0bc d\n中文\U0001f600\n", "x <P> y\nz", "<S", "<S><M", "ends with <\nand <S\n<M\n<", "a\n" * 20_000, "w" * 300_000]


@pytest.mark.parametrize(("percent", "spm", "unit"), [(100, 50, None), (60, 10, None), (100, 50, r"\S+\s*|\s+")])
def test_fill_in_middle(spark, percent, spm, unit):
    from siftlake.llm.fill_middle import fill_in_middle, restored

    rows = [(k, t) for k, t in enumerate(TEXTS * 3)] + [(None, "a\nb"), (4, "one"), (4, "one"), (-5, "p\nq\nr\n")]
    docs = spark.createDataFrame([(i, t, "x", 1.5) for i, t in rows], "doc_id long, text string, form string, n double").repartition(3)
    own = {"unit": unit} if unit else {}
    out = fill_in_middle(docs, percent=percent, spm_percent=spm, **own).withColumn("back", restored())
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    want = sorted(((*plain_middle(i, t, percent=percent, spm=spm, **own), t or "") for i, t in rows), key=repr)
    assert got == want
    assert fill_in_middle(docs.limit(0)).collect() == []
    assert {r[2] for r in want} == {"plain", "psm", "spm"}


def test_cut_points_keep_no_units():
    from siftlake.llm.fill_middle import LINES, cut_points

    unit = re.compile(LINES)
    for draw in ((0, 0), (3, 3), (0, 4), (4, 1), (7, 9)):
        n, low, high = cut_points(unit, "a\nbb\n\nc", draw)
        units = ["a\n", "bb\n", "\n", "c"]
        a, b = sorted(d % 5 for d in draw)
        assert (n, low, high) == (4, len("".join(units[:a])), len("".join(units[:b])))


# ---------------------------------------------------------------- conversation repair


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if lot == 0:
            continue
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        out += [(conv, turn, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))


def cheapest(faults, roles, cost=(0, 1, 2, 5, 5)):
    """(cost, audit, roles of the repaired rows) by search over whole edit sequences, cheapest and least first."""
    keep, rerole, delete, insert, truncated = cost
    # cost, audit, rows read, initials so far reduced to a state of (s?(ua)+)?, repaired
    heap, seen = [(0, "", 0, "", ())], set()
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    while heap:
        c, audit, k, q, out = heapq.heappop(heap)
        if (k, q) in seen:
            continue
        seen.add((k, q))
        if k == len(faults) and q in ("", "a"):
            return c, audit, out
        for r in ("user", "assistant"):
            if (q, r[0]) in follow:
                heapq.heappush(heap, (c + insert, audit + "I", k, follow[q, r[0]], (*out, (None, r))))
        if k == len(faults):
            continue
        heapq.heappush(heap, (c + delete, audit + "D", k + 1, q, out))
        if faults[k] in ("blank", "duplicate"):
            continue
        more = truncated if faults[k] == "truncated" else 0
        if (q, roles[k][:1]) in follow:
            heapq.heappush(heap, (c + keep + more, audit + "K", k + 1, follow[q, roles[k][:1]], (*out, (k, roles[k]))))
        for r in ("user", "assistant"):
            if (q, r[0]) in follow:
                heapq.heappush(heap, (c + rerole + more, audit + "R", k + 1, follow[q, r[0]], (*out, (k, r))))
    raise AssertionError


def plain_repair(rows, ids):
    result = []
    for conv in ids:
        own = ordered([r for r in rows if r[0] == conv])
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults, before = [], set()
        for r in own:
            bare = r[3].strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if r[2:] in before else "ok" if bare[-1] in ".!?" else "truncated")
            before.add(r[2:])
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, out = cheapest(faults, [r[2] for r in own])
        text = "\n".join(f"{role}:{'' if k is None else own[k][3]}" for k, role in out)
        result.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(result, key=repr)


def conversations(seed=3, n=60):
    rnd = random.Random(seed)
    texts = ["fine.", "good!", "no end", "", "  \t\n", "why?", "x.\x0b\n ", "　", "¿qué? 中文", "cut, ", None]
    rows = []
    for conv in range(n):
        for turn in range(rnd.choice([0, 1, 2, 3, 5, 9])):
            text = rnd.choice(texts) if rnd.random() < 0.4 else f"text {conv} {turn}."
            rows.append((conv, turn * rnd.choice([1, 1, 1, 3]), rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), text))
    rows += [(None, None, None, None), (None, None, "user", "a."), (None, 3, "assistant", "b."), (500, None, "user", "x."), (501, 0, "system", "only."), (502, 5, "user", "twice."), (502, 5, "user", "twice.")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_conversation_repair(spark, seed):
    from siftlake.llm.conversation_repair import audits, damage, repair, repaired_digests

    rows = conversations(seed)
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, copies int").repartition(5)
    ids = {r[0] for r in rows}
    got = sorted((tuple(r) for r in repaired_digests(damage(df)).collect()), key=repr)
    want = plain_repair(damaged(rows), ids)
    assert got == want
    clean = df.select("conv_id", "turn", "role", "text")
    whole = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert sorted((tuple(r) for r in audits(clean).collect()), key=repr) == sorted((r[:-1] for r in plain_repair(whole, ids)), key=repr)
    lines = {}
    for r in repair(clean).orderBy("conv_id", "position").collect():
        assert r.edit in "KRI"
        assert r.position == len(lines.setdefault(r.conv_id, [])) + 1
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    wanted = {r[0]: r[-1] for r in plain_repair(whole, ids)}
    assert all(hashlib.sha256("\n".join(v).encode()).hexdigest() == wanted[k] for k, v in lines.items())
    assert repaired_digests(damage(df.limit(0))).collect() == []


def test_repairs_with_other_costs():
    """Cheap insertions and dear deletions take the arcs that the contract's costs never do."""
    from siftlake.llm.conversation_repair import BLANK, DUPLICATE, OK, TRUNCATED, Costs, Repairer, symbol

    rnd = random.Random(5)
    names = {OK: "ok", BLANK: "blank", DUPLICATE: "duplicate", TRUNCATED: "truncated"}
    for cost in ((0, 1, 2, 5, 5), (0, 3, 9, 1, 1), (0, 2, 2, 2, 0), (0, 7, 1, 1, 9), (0, 1, 1, 1, 1)):
        machine = Repairer(Costs(*cost))
        for _ in range(300):
            n = rnd.randrange(0, 9)
            roles = [rnd.choice(["user", "assistant", "system", "tool", ""]) for _ in range(n)]
            faults = [rnd.choice([OK, OK, OK, BLANK, DUPLICATE, TRUNCATED]) for _ in range(n)]
            got = machine.repair(bytes(symbol(r, f) for r, f in zip(roles, faults, strict=True)))
            assert got == cheapest([names[f] for f in faults], roles, cost)[:2]
        assert len(machine.vectors) < 100


def test_a_long_conversation(spark):
    from siftlake.llm.conversation_repair import audits

    df = spark.range(60_000).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id, '.') as text")
    (row,) = audits(df).collect()
    assert (row.cost, row.audit) == (0, "K" * 60_000)


# ---------------------------------------------------------------- HTML

ARTICLE = " ".join(["A sentence of the article that has a number of words."] * 4)
LONG = "The second paragraph goes on for a while, so that nobody takes it for a menu or a notice of any kind at all."

PAGES = [
    # page furniture named by elements, raw text, references
    (
        f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no";</script></head><body><header><a href="/">Home</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
        <div class="cookie-notice">We use cookies on this page. <button>Accept</button></div><main><article><h1>Title &amp; more</h1><p>{ARTICLE}</p><p>Short.</p><!-- <p>no</p> --><p>caf&eacute;&nbsp;&#8212;\n\t <b>bo</b>ld&lt;br&gt;<br>next</p>
        <aside><p>{LONG}</p></aside><div class="ad">Buy now, a long line of advert text here today.</div><form><label>Your mail</label><input value="x"></form></article></main>
        <section id="comments"><article class="comment"><p>{LONG}</p></article></section><footer>&copy; all of it</footer></body></html>""",
        ["Title & more", ARTICLE, "Short.", "café — bold<br> next"],
    ),
    # names only
    (
        f"""<body><div id="top-menu"><a href=a>Start</a> <a href=b>News</a></div><div class="page-with-sidebar"><div class=sidebar><p>{LONG}</p></div><div class="post-content"><h2>Heading</h2><p>{ARTICLE}</p><p>Two words</p></div></div>
        <div class="comments-area"><p>{LONG}</p></div><div class="site-footer"><p>{LONG}</p></div>""",
        ["Heading", ARTICLE, "Two words"],
    ),
    # no names at all
    (f'<table><tr><td><a href=1>One</a><td><a href=2>Two links</a></tr></table><h1>The heading of it all</h1><p>{ARTICLE}<p>{LONG}<p><a href=x>Next</a> | <a href=y>Back</a>', ["The heading of it all", ARTICLE, LONG]),
    # hidden, templates, unclosed tags and odd markup
    (f'<article><p hidden>no<p style="display: none">no<template><p>{LONG}</p></template><p title="a > b">{ARTICLE}<p>1 < 2 and </3> 5 & 6<svg><text>no</text></svg><noscript><p>{LONG}</p></noscript><p>{LONG}<!-- never closed', [ARTICLE, "1 < 2 and 5 & 6", LONG]),
    ("", []),
    (None, []),
    ("<script>never closed <p>" + LONG, []),
    ("<nav><a href=x>only</a></nav>", []),
]


def test_extract_pages(spark):
    from siftlake.llm.html_extraction import extract

    rows = [(k, f"http://x/{k}" if k else None, page, "other", 1) for k, (page, _) in enumerate(PAGES)]
    rows += [(None, None, None, None, None), (0, "again", PAGES[0][0], "", 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").repartition(3)
    got = {(r.page_id, r.url): r for r in extract(df).collect()}
    for k, (_, want) in enumerate(PAGES):
        r = got[k, f"http://x/{k}" if k else None]
        assert r.text == "\n\n".join(want), k
        assert r.n_chars == len(r.text)
    assert got[0, "again"].text == got[0, None].text
    assert got[None, None].text == ""
    assert extract(df.limit(0)).collect() == []


def test_extract_the_tables_articles(spark):
    """On the given pages the article element tells what is right; the extractor's features also work when it is not marked."""
    import html as H

    from siftlake.llm.html_extraction import blocks, chance, described, grow, labelled_table, main_text

    tree = grow(*labelled_table())
    right = wrong = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        want = [x for x in (" ".join(H.unescape(re.sub("</?b>", "", p).replace("<br>", " ")).split()) for p in re.split("</?(?:p|h1)>", inner)) if x]
        assert main_text(r.html, tree)[0] == "\n\n".join(want)
        bare = re.sub(r"</?(?:article|nav|footer)>", "<div>", r.html)
        found = blocks(bare.replace('class="ad"', ""))
        n = collections_of(want)
        for b, row in zip(found, described(found), strict=True):
            ok = (chance(tree, row) >= 0.5) == (n.get(b.text, 0) > 0)
            right, wrong = right + ok * b.words, wrong + (not ok) * b.words
    assert right / (right + wrong) > 0.9, (right, wrong)


def collections_of(x):
    out = {}
    for k in x:
        out[k] = out.get(k, 0) + 1
    return out


def test_the_tree_learns_its_table():
    from siftlake.llm.html_extraction import chance, grow, labelled_table

    rows, labels = labelled_table()
    tree = grow(rows, labels)
    assert sum((chance(tree, r) >= 0.5) == y for r, y in zip(rows, labels, strict=True)) >= 0.98 * len(rows)
    assert grow(rows, [1] * len(rows)) == 1


def test_scanning_is_linear():
    """Hostile pages: nothing is scanned again and again."""
    import time

    from siftlake.llm.html_extraction import blocks

    n = 200_000
    began = time.time()
    for page in ("<" * n, "<a " * n, '<a x="' * n, "<!--" * n, "<p>" * n, "<b>" * n + "</i>" * n, "<ul>" * n + "<li>x" * n, "<a href='>" * n, "</p>" * n, "&amp" * n, "<script>" * n, "<td><b>" * n, '<a ">" ' * n, "<p><div>x" * n):
        blocks(page)
    assert time.time() - began < 60
