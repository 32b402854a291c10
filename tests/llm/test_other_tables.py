"""Operators on pages, conversations and embeddings against brute force, odd rows and empty tables; the pipeline; plans."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from barloom.llm import chat, embeddup, pages, pii, quality, urls

from .frames import CLASHES, edited, frame, odd_rows, prose

# -- url filters -------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string"


def ruled(url):
    import re

    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_url_rules(spark):
    made = ["http://A.Example.com/en/1?x", "https://www.example.com/en/", "http://x.org", "http://x.net/es/", "http://x.net/es", "no url", None, "",
            "a://b://c/d", "http://notexample.com/en/x", "http://example.com/en/#top", "http:///en/", "http://ÄÖ.net/fr/a b"]
    rows = [(i, u, None) for i, u in enumerate(made)] + [(0, made[0], None)]
    got = urls.judge(frame(spark, rows, PAGES), urls.rule_table(spark, urls.RULES)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = ruled(made[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == want[:3]
        assert r["verdict"] == want[3] or want[3] is None and r["verdict"] in ("allow", "block")
    assert urls.judge(frame(spark, [], PAGES), urls.rule_table(spark, urls.RULES)).count() == 0


@pytest.mark.parametrize("crowded", [1000, 10, 1])
def test_url_scores(spark, monkeypatch, crowded):
    """With all hosts crowded, some and none."""
    monkeypatch.setattr(urls, "CROWDED", crowded)
    rng = random.Random(4)
    hosts = [f"h{i}.{rng.choice(['com', 'net', 'org'])}" for i in range(12)]
    rows = []
    for i in range(120):
        to = rng.choices(hosts, k=rng.randint(0, 4))
        html = "".join(f'<a class="x" href="http://{t}/y">t</a>' for t in to)
        rows.append((i, f"http://{rng.choice(hosts)}/{rng.choice(['es', 'fr', 'en'])}/p", html))
    got = urls.judge(frame(spark, rows, PAGES), urls.rule_table(spark, urls.RULES)).collect()
    verdicts = {r[0]: ruled(r[1]) for r in rows}
    edges: dict = {}
    for _, url, html in rows:
        src = ruled(url)[0]
        for dst in {x.split("/")[0] for x in html.split("http://")[1:]} - {src}:
            edges[src, dst] = edges.get((src, dst), 0) + 1
    every = {v[0] for v in verdicts.values()} | {d for _, d in edges}
    share = {h: [np.mean([v[3] == kind for v in verdicts.values() if v[0] == h] or [0]) for kind in ("allow", "block")] for h in every}
    trust, distrust = ({h: s[k] for h, s in share.items()} for k in (0, 1))
    out = {h: sum(n for (a, _), n in edges.items() if a == h) for h in every}
    into = {h: sum(n for (_, b), n in edges.items() if b == h) for h in every}
    for _ in range(300):
        t = {h: share[h][0] + 0.85 * sum(n / out[a] * trust[a] for (a, b), n in edges.items() if b == h) for h in every}
        d = {h: share[h][1] + 0.85 * sum(n / into[b] * distrust[b] for (a, b), n in edges.items() if a == h) for h in every}
        trust, distrust = t, d
    for r in got:
        h = r["host"]
        assert r["trust"] == pytest.approx(trust[h], abs=1e-3) and r["distrust"] == pytest.approx(distrust[h], abs=1e-3)
        if r["rule"] is None:
            bad = share[h][1] - share[h][0] >= urls.MARGIN or distrust[h] >= urls.MARGIN and distrust[h] > trust[h]
            assert r["verdict"] == ("block" if bad else "allow")


def link(host):
    return f'<a href="http://{host}/p">x</a>'


def test_url_linked_seed_stays_blocked_and_outranks_its_linker(spark):
    """Links to a blocked host change nothing about it, and its linkers come below it, along a chain of any length."""
    chain = [f"h{i}.org" for i in range(30)]
    rows = [(i, f"http://{a}/p", link(b)) for i, (a, b) in enumerate(zip(chain, chain[1:]))]
    rows += [(50 + i, "http://h29.org/x/", None) for i in range(9)] + [(60, "http://h29.org/y/", None), (61, "http://far.org/x", None)]
    rules = spark.createDataFrame([("block", "h29.org", "/x/")], "verdict string, suffix string, path string")
    got = {r["page_id"]: r for r in urls.judge(frame(spark, rows, PAGES), rules).collect()}
    assert got[60]["rule"] is None and got[60]["verdict"] == "block" and got[60]["distrust"] == pytest.approx(0.9)
    for hops in range(1, 30):
        assert got[29 - hops]["distrust"] == pytest.approx(0.9 * 0.85**hops, abs=1e-4)
        assert got[29 - hops]["verdict"] == ("block" if 0.9 * 0.85**hops >= 0.5 else "allow")
    assert got[61]["distrust"] == 0 and got[61]["verdict"] == "allow"


def test_url_trust_outweighs_distrust(spark):
    rows = [(i, f"http://good{i}.org/a/", link("mid.net")) for i in range(3)] + [(10, "http://mid.net/q", link("bad.net")), (11, "http://bad.net/b/", None)]
    rules = spark.createDataFrame([("allow", "org", "/"), ("block", "bad.net", "/b/")], "verdict string, suffix string, path string")
    got = {r["page_id"]: r for r in urls.judge(frame(spark, rows, PAGES), rules).collect()}
    assert (got[10]["trust"], got[10]["distrust"], got[10]["verdict"]) == (pytest.approx(2.55), pytest.approx(0.85), "allow")
    without = {r["page_id"]: r["verdict"] for r in urls.judge(frame(spark, rows[3:], PAGES), rules).collect()}
    assert without == {10: "block", 11: "block"}


# -- chat --------------------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def test_chat_escapes_are_reversible():
    rng = random.Random(1)
    parts = ["<", "|", "\\", "[", "INST]", "/INST]", "s>", "/s>", "<SYS>>", "a", ">", "/", "\n"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text and chat.unescape_role(chat.escape_role(text)) == text
        assert not any(c in safe for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_chat_examples(spark):
    rows = [(1, 0, "system", "be <|end|>\n brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "<|turn|>user\nyo\\"), (1, 3, "user", None), (1, 4, "assistant", "é\U0001f600"),
            (2, 0, "user", "x"), (3, 0, "assistant", ""), (4, 0, "assistant", "a"), (4, 1, None, "b"), (None, 0, "assistant", "n"), (5, 0, "we\nird\\", "z"),
            (6, 0, "assistant", "same"), (6, 0, "assistant", "same"), (7, 0, "user", "y" * 300_000), (7, 1, "assistant", "z" * 300_000)]
    made = frame(spark, rows, TURNS).repartition(3)
    examples = chat.expand(made).collect()
    assert sum(1 for e in examples if e["loss_end"] > e["loss_start"] or e["text"]) == len(examples)
    replies = [r for r in rows if r[2] == "assistant"]
    open_ends = 4  # conversations 2, 4, 5 and none else end without a reply
    assert len(examples) == len(replies) + open_ends - 1
    got = {r["conv_id"]: r for r in chat.digest(chat.expand(made)).collect()}
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv]["n_turns"] == len(own) and got[conv]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert got[conv]["loss_chars"] == len(loss) and got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[conv]["formatted_chars"] == sum(len(e["text"]) for e in examples if e["conv_id"] == conv)
    one = sorted((e for e in examples if e["conv_id"] == 1), key=lambda e: e["example"])
    assert chat.turns_of(one[1]["text"])[:3] == [(r[2], r[3]) for r in rows[:3]] and one[1]["text"].startswith(one[0]["text"])
    assert chat.digest(chat.expand(frame(spark, [], TURNS))).count() == 0


# -- html --------------------------------------------------------------------------------------------------------------


def site(i, body, note="Read our weekly letter."):
    return (f'<!DOCTYPE html><html><head><title>t{i}</title><script>var a="<p>";</script></head><body><nav><ul><li><a href="/{i}">{i}</a></ul></nav>'
            f'<div class="ad">Buy {i}</div><article><h1>Title {i} &amp; more</h1><div>{note}</div>{body}<div class="comments"><p>me too</div></article>'
            f'<aside>side {i}</aside><footer>&copy; {i}</footer></body>')


def test_html_wrapper_goes(spark):
    rows = [(i, f"http://a.org/{i}", site(i, f"<p>{prose(i, 30)}<p><b>{prose(50 + i, 20)}<br>end</p>")) for i in range(8)]
    rows += [(100, "http://b.org/x", site(100, "<p>alone\n  here</p>")), (101, None, None), (102, "http://c.org", ""), (103, "http://c.org", "plain &lt; text"),
             (104, "http://c.org", "<div>" * 3000 + "deep"), (105, "http://d.org", "<p>a<!-- never closed"), (0, rows[0][1], rows[0][2])]
    got = {}
    for r in pages.texts(frame(spark, rows, PAGES).repartition(3)).collect():
        assert got.setdefault(r["page_id"], r["text"]) == r["text"] and r["n_chars"] == len(r["text"])
    for i in range(8):
        assert got[i] == f"Title {i} & more\n{prose(i, 30)}\n{prose(50 + i, 20)} end"
    assert got[100] == "Title 100 & more\nRead our weekly letter.\nalone here"  # no wrapper from one page
    assert (got[101], got[102], got[103], got[104], got[105]) == ("", "", "plain < text", "deep", "a")
    assert pages.texts(frame(spark, [], PAGES)).count() == 0


def test_html_copies_are_no_wrapper(spark):
    text = "".join(f"<p>{prose(k, 25)}</p>" for k in range(6))
    rows = [(i, "http://a.org/", site(1, text)) for i in range(30)]
    want = "\n".join(["Title 1 & more", "Read our weekly letter.", *(prose(k, 25) for k in range(6))])
    assert {r["text"] for r in pages.texts(frame(spark, rows, PAGES)).collect()} == {want}


def test_html_much_boilerplate_is_wrapper(spark):
    """Short articles between long unnamed menus and notices."""
    menu, legal = prose(900, 150), prose(901, 200)
    rows = [(i, f"http://{host}.org/{i}", f"<body><div>{menu}</div>{start}<p>{prose(300 + i, 30)}</p><div>{legal}</div>{end}</body>")
            for host, start, end in (("plain", "", ""), ("marked", "<article>", "</article>")) for i in range(6)]
    for r in pages.texts(frame(spark, rows, PAGES)).collect():
        assert r["text"] == prose(300 + r["page_id"], 30)


def test_html_article_in_parts():
    parts = "".join(f"<article><p>part {i} {prose(i, 20)}</p></article>" for i in range(3))
    assert pages.extract(f"<body>{parts}</body>").count("part") == 3
    long = prose(5, 80)
    got = pages.extract(f"<body><div class=content><p>{long}</p></div><article><p>a teaser</p></article></body>")
    assert got == f"{long}\na teaser"
    for name in ("entry-header", "post-header", "header"):
        assert pages.extract(f'<article><div class="{name}"><h1>The title</h1></div><p>{long}</p><div class="comments">x</div></article>') == f"The title\n{long}"
    assert pages.extract(f'<body><div class="site-header">menu</div><p>{long}</p></body>') == long


def test_html_templates_of_one_host(spark):
    """Two templates and pages without text on one host: each template's constants go."""
    note, other = prose(910, 25), prose(911, 25)
    rows = [(i, f"http://a.org/{i}", f"<body><div><p>{note}</p></div><section><p>{prose(400 + i, 30)}</p></section></body>") for i in range(8)]
    rows += [(20 + i, f"http://a.org/{i}", f"<body><table><tr><td>{prose(420 + i, 30)}</td><td>{other}</td></tr></table></body>") for i in range(7)]
    rows += [(50 + i, f"http://a.org/{i}", html) for i, html in enumerate(["", "  ", "<html></html>"] * 8)]
    for r in pages.texts(frame(spark, rows, PAGES)).collect():
        assert r["text"] == ("" if r["page_id"] >= 50 else prose(400 + r["page_id"], 30))


# -- embeddings --------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_links(rows):
    units = []
    for _, v, _ in rows:
        a = None if v is None or not v or any(x is None for x in v) else np.array(v, np.float32).astype(np.float64)
        units.append(None if a is None or not np.isfinite(a).all() or not a.any() else a / np.linalg.norm(a))
    n = len(rows)
    near = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j])
             and units[i] @ units[j] >= embeddup.COSINE] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(near[i]), min(ids) if ids else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("tile", [2048, 40])
def test_embedding_links(spark, tile, monkeypatch):
    monkeypatch.setattr(embeddup, "TILE", tile)
    rng = np.random.default_rng(5)
    rows, ident = [], 0
    for group in range(40):
        base = rng.normal(size=6)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((ident, [float(x) for x in np.float32(base + rng.normal(size=6) * 0.12)], group))
            ident += 1
    rows += [(ident + k, rows[0][1], 0) for k in range(30)] + [(0, rows[0][1], 0), (ident + 40, [2 * x for x in rows[0][1]], 0)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 6, 1), (903, [float("nan")] * 6, 1), (904, [None] + [1.0] * 5, 1), (905, [1.0, 0.0], 1),
             (906, [1.0, 0.01], 1), (None, [1.0, 0.0], 1), (None, None, 1), (907, [float("inf")] + [1.0] * 5, 1)]
    # TILE is read where the plan is made, on the driver
    got = embeddup.links(frame(spark, rows, VECTORS).repartition(3)).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == brute_links(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("limit", [4000, 32_000_000])
def test_embedding_shares(spark, monkeypatch, limit):
    """Vectors that may all have links in all cells are sent once, in shares of bounded size, and links across shares, cells and lengths come out right."""
    monkeypatch.setattr(embeddup, "TILE", 16)
    monkeypatch.setattr(embeddup, "SHARE_BYTES", limit)
    rng = np.random.default_rng(9)
    made = list(rng.normal(size=(300, 8))) + [rng.normal(size=8) + 4 for _ in range(60)] + list(rng.normal(size=(20, 5)))
    rows = [(i, [float(x) for x in np.float32(v)], 0) for i, v in enumerate(made)]
    got = embeddup.links(frame(spark, rows, VECTORS).repartition(3)).collect()
    want = brute_links(rows)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == want and sum(n for _, n, _ in want) > 100
    homes = [(bytes([i % 256, i // 256] * 8), np.array(v, np.float32).tobytes(), 1, i % 7 if len(v) == 8 else -5) for i, v, _ in rows]
    packed, count = embeddup.shares(spark.createDataFrame(homes, "digest binary, vector binary, copies long, cell int"), "<f4")
    packed = packed.collect()
    assert 1 < len(packed) <= count and sum(sum(r["sizes"]) for r in packed) == len(rows)
    assert sorted(bytes(r["digests"][i:i + 16]) for r in packed for i in range(0, len(r["digests"]), 16)) == sorted(h[0] for h in homes)
    assert all(len(r["vectors"]) <= limit for r in packed)


def test_embedding_rounding_at_the_threshold():
    """Cosines next to COSINE are decided in double precision."""
    rng = np.random.default_rng(2)
    left = rng.normal(size=(40, 16))
    left /= np.linalg.norm(left, axis=1, keepdims=True)
    right, wanted = [], []
    for i, a in enumerate(left):
        other = rng.normal(size=16)
        other -= other @ a * a
        cosine = embeddup.COSINE + (1e-9 if i % 2 else -1e-9)
        right.append(cosine * a + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other))
        wanted += [(i, i)] * (i % 2)
    one, two = embeddup.linked(left, np.stack(right))
    assert sorted(zip(one.tolist(), two.tolist())) == wanted


def test_embedding_empty(spark):
    assert embeddup.links(frame(spark, [], VECTORS)).count() == 0


# -- pipeline and plans ------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    rows = [(i, prose(i, 120) + (" a@b.org" if i % 3 == 0 else ""), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, edited(rows[i][1], i, 0.03), "en", "s0", 1) for i in range(10)] + [(200, "short", "en", "s1", 1), (201, None, None, None, None)]
    frame(spark, rows, clashes=False).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        if name != "mixing":
            assert docs.select("doc_id").distinct().count() == docs.count()
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(left) == set(range(60)) and not any("@" in t for t in left.values())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == set(range(60))
    assert corpus_pipeline.run.__doc__ and len(corpus_pipeline.STAGES) == 5


def test_pipeline_on_no_rows(spark, tmp_path):
    frame(spark, [], clashes=False).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_filter_of_the_quality_stage_repeats_nothing(spark, tmp_path):
    """The filter stays above the steps that lead to the verdict."""
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    plan = quality.stage_quality(spark, frame(spark, odd_rows()), str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate") < plan.index("aggregate(")
    assert plan.count("split(") <= 2


def test_native_plans_run_no_python(spark):
    docs = frame(spark, odd_rows())
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for made in (pii.redact(pii.find(docs)), quality.judge(docs, quality.fit(docs, labels))):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow", "Exchange"))
    assert len(set(CLASHES)) == len(CLASHES)
