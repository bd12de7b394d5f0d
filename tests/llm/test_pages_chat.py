import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import html_extract, tool_chat, url_filter

PAGES = "page_id long, url string, html string, host string, text string, number int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "h", "t", 1) for i, u, h in rows], PAGES)


def brute_url(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for kind, rule in url_filter.RULES:
        own, tail = rule.split("/", 1)
        if (host == own or host.endswith("." + own)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[1])):
            best = (kind, rule)
    return host, path, best


URLS = [None, "", "nothing", "http://", "http://com/", "http://a.com", "http://a.com/", "HTTPS://WWW.Example.COM/en/x?y=/z#q", "http://example.com/en/", "http://xexample.com/en/", "http://m.example.com/en", "http://a.net/es/1", "http://net/fr/", "http://a.net/en/", "x://É.net/es/#", "http://a.net?es/", "http://a.org/x?u=http://b.com/"]


def test_rules_equal_brute_force(spark):
    found = url_filter.judge_urls(pages(spark, [*((i, u, None) for i, u in enumerate(URLS)), (4, URLS[4], None)])).collect()
    assert len(found) == len(URLS) + 1
    for r in found:
        host, path, best = brute_url(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[1])
        if best:
            assert r.verdict == best[0]
    assert url_filter.judge_urls(pages(spark, [])).count() == 0


def link(*hosts):
    return "".join(f"<p><a class=x href='//{h}/a'>x</a> <a href=/local>y</a></p>" for h in hosts)


def brute_ranks(seeds, edges, damping=0.85):
    hosts = sorted({h for e in edges for h in e[:2]} | set(seeds))
    at = {h: i for i, h in enumerate(hosts)}
    w = np.zeros((len(hosts), len(hosts)))
    for a, b, n in edges:
        w[at[a], at[b]] = n
    forward = w / np.maximum(w.sum(1, keepdims=True), 1)
    back = (w / np.maximum(w.sum(0, keepdims=True), 1)).T
    s = np.array([seeds.get(h, (0, 0, 0)) for h in hosts], dtype=float) * (1 - damping)
    out = [np.linalg.solve(np.eye(len(hosts)) - damping * m.T, s[:, k]) for k, m in enumerate((forward, back, forward))]
    return {h: tuple(o[i] for o in out) for h, i in at.items()}


def test_propagation_equals_the_linear_system(spark):
    edges = [("a", "b", 1), ("b", "c", 2), ("b", "a", 1), ("d", "c", 5), ("c", "d", 1), ("e", "d", 1)]
    seeds = {"a": (3, 0, 0), "c": (0, 4, 1), "e": (0, 0, 2), "lone": (1, 1, 0)}
    found = url_filter.propagate(spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, trust long, distrust long, neutral long"), spark.createDataFrame(edges, "src string, dst string, links long"), tolerance=1e-4)
    expected = brute_ranks(seeds, edges)
    got = {r.host: (r.trust, r.distrust, r.neutral) for r in found.collect()}
    assert got.keys() == expected.keys()
    for h, values in expected.items():
        assert np.allclose(got[h], values, atol=0.01)


def test_hosts_that_link_to_blocked_ones_are_blocked(spark):
    rows = [(1, "http://bad.net/es/1", ""), (2, "http://bad.net/es/2", ""), (3, "http://bad.net/fr/2", ""), (4, "http://farm.org/1", link("bad.net")), (5, "http://calm.org/", link("good.com")), (6, "http://good.com/", link("calm.org", "good.com"))]
    verdict = {r.page_id: r.verdict for r in url_filter.judge_urls(pages(spark, rows)).collect()}
    assert verdict == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow"}


PAGE = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy</div><article><h1>Title &amp;amp; x</h1><p><b>Bold   text\n here<br><p>Second &lt;p&gt;&nbsp;&copy;</p><p></p><div class="comment">Nice!</div><ul><li>one<li>two</ul></article><footer>foot</footer></body></html>'


def test_a_declared_article_is_extracted_whole(spark):
    expected = "Title &amp; x\nBold text here\nSecond <p> ©\none\ntwo"
    rows = [(1, "http://h/1", PAGE), (1, "http://h/1", PAGE), (2, None, None), (3, "http://h/2", ""), (4, "http://h/3", "plain & text"), (None, "u", "<p>x" * 3000)]
    found = sorted(html_extract.extract_pages(pages(spark, rows)).collect(), key=lambda r: (r.page_id or 0, r.url or ""))
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in found] == [(None, "u", "\n".join("x" * 3000), 5999), (1, "http://h/1", expected, len(expected)), (1, "http://h/1", expected, len(expected)), (2, None, "", 0), (3, "http://h/2", "", 0), (4, "http://h/3", "plain & text", 12)]
    assert html_extract.extract_pages(pages(spark, [])).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div>a<p>b</p>c</div>", "a\nb\nc"),
        ("<p>a<!-- x --> b <i>c</i>d</p>", "a b cd"),
        ("<p>a <button>go</button> b</p>", "a b"),
        ("<main><aside>no</aside><header><h1>yes</h1></header></main><p>outside</p>", "yes"),
        ("<div role=navigation>n</div><section hidden>h</section><p style='display: none'>d</p><p>t</p>", "t"),
        ("<header>site</header><div class='page-header'>top</div><p>t</p>", "t"),
        ("<article><header><h1>h</h1></header><p>t</p><footer>f</footer></article>", "h\nt"),
        ("<p title='a > b'>x</p><form><input name=q>find</form>", "x"),
        ("<script>if (a<b) '<p>no</p>'</script>yes</div></p>", "yes"),
        ("a < b and 3<4", "a < b and 3<4"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
        ("&#233;&eacute;&bogus;", "éé&bogus;"),
        ("<div class='main ads-box'>x</div><div class=loads>y</div>", "y"),
    ],
)
def test_extraction_of_small_pages(page, text):
    assert html_extract.extract(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><h2 id=comment-syntax>Syntax</h2><section id=discussion><p>a</p></section><p id=search-results>b</p><ul class=menu><li>soup</ul></article>", "Syntax\na\nb\nsoup"),
        ("<h2 id=comment-syntax>Syntax</h2><section id=notice-period>a</section>", "Syntax\na"),
        ("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds</p><div hidden>more</div><p aria-hidden=true>c</p></article>", "so x=2 holds\nmore\nc"),
        ("<article><p>a</p><div class='box comments'>c</div><div class=ad>d</div><p class='notice'>n</p><div role=search>s</div><p class=comment-syntax>b</p></article>", "a\nb"),
    ],
)
def test_ids_and_words_do_not_take_text_of_an_article(page, text):
    assert html_extract.extract(page) == text


def test_style_tree_finds_what_a_host_repeats(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = [" ".join(word() for _ in range(30)) for _ in range(30)]
    rows = [(i, f"http://one.org/{i}", f"<div class=top><p>Welcome to our site</p><p>Since 1990</p></div><div class=body><p>{t}</p></div><div class=end><p>All rights reserved</p></div>") for i, t in enumerate(texts)]
    rows += [(100 + i, f"http://h{i}.org/", "<div><p>Welcome to our site</p></div>") for i in range(10)]
    found = {r.page_id: r.text for r in html_extract.extract_pages(pages(spark, rows)).collect()}
    assert [found[i] for i in range(30)] == texts
    assert all(found[100 + i] == "Welcome to our site" for i in range(10))  # one page a host repeats nothing


def test_style_tree_reaches_into_articles(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = [[" ".join(word() for _ in range(30)) for _ in range(rng.choice([2, 3, 4, 5]))] for _ in range(30)]
    box = "<p>Call us today</p><div class=who><h3>About the writer</h3><p>Ann writes here.</p></div>"
    page = lambda i, t: f"<main><h2>Summary</h2>{''.join(f'<p>{x}</p>' for x in t)}<table><tr><td>yes<td>{i}</table>{box}</main>"
    rows = [(i, f"http://one.org/{i}", page(i, t)) for i, t in enumerate(texts)]
    rows += [(100 + i, f"http://copies.org/{i}", f"<div>{word()}</div><article><p>{texts[0][0]}</p><p>Same</p></article>") for i in range(10)]
    rows += [(200 + i, f"http://near.org/{i}", f"<article><p>{texts[0][0]}</p><p>{texts[0][1]}</p><p>{word()}</p></article>") for i in range(10)]
    found = {r.page_id: r.text for r in html_extract.extract_pages(pages(spark, rows)).collect()}
    assert [found[i] for i in range(30)] == ["\n".join(["Summary", *t, "yes", str(i)]) for i, t in enumerate(texts)]
    assert all(found[100 + i] == f"{texts[0][0]}\nSame" for i in range(10))  # copies of an article count once
    assert all(found[200 + i].startswith("\n".join(texts[0][:2])) for i in range(10))  # near copies keep their text


def test_a_teaser_is_not_the_main_text(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = [" ".join(word() for _ in range(60)) for _ in range(10)]
    rows = [(i, f"http://one.org/{i}", f"<div class=body><p>{t}</p></div><article><p>Read this as well</p></article>") for i, t in enumerate(texts)]
    rows += [(100, "http://two.org/", f"<div><p>{texts[0]}</p></div><article>Read this</article>")]
    found = {r.page_id: r.text for r in html_extract.extract_pages(pages(spark, rows)).collect()}
    assert [found[i] for i in range(10)] == texts
    assert found[100] == f"{texts[0]}\nRead this"


def brute_importance(roots):
    """Importance of every branch by the definition, on nested dictionaries; roots: [(page, tree)]."""
    from collections import Counter, defaultdict

    values = defaultdict(Counter)
    rows = {p: list(html_extract.style_rows(t, "h")) for p, t in roots}
    for own in rows.values():
        for _, _, place, kind, value in own:
            if kind != html_extract.FIXED:
                values[place][value] += 1

    def node(page, number):
        _, _, place, kind, value = next(r for r in rows[page] if r[0] == number)
        if kind == html_extract.FIXED:
            return float(value)
        n = values[place]
        m = sum(n.values())
        if m < html_extract.MIN_PAGES:
            own = 1.0
        elif kind == html_extract.LEAF:
            own = 1 - np.log(n[value]) / np.log(m)
        else:
            own = -sum(c / m * np.log(c / m) for c in n.values()) / np.log(m)
        below = [node(page, r[0]) for r in rows[page] if r[1] == number]
        decay = html_extract.DECAY ** len(n)
        return (1 - decay) * own + decay * np.mean(below) if below else own

    return {(p, r[0]): node(p, r[0]) for p, own in rows.items() for r in own}


def test_branch_importance_equals_the_definition(spark):
    rng = random.Random(2)
    trees = [(p, html_extract.parse("".join(f"<div class={rng.choice('ab')}><p>{rng.choice(['same', 'other', str(rng.random())])}</p><nav>x</nav></div>" for _ in range(rng.choice([1, 2]))) + "<p>end</p>")) for p in range(14)]
    expected = brute_importance(trees)
    from collections import Counter

    rows = [(p, *r) for p, t in trees for r in html_extract.style_rows(t, "h")]
    same = Counter((r[3], r[5]) for r in rows if r[4] != html_extract.FIXED)
    total, styles, entropy = Counter(), Counter(), Counter()
    for (place, _), c in same.items():
        total[place] += c
        styles[place] += 1
        entropy[place] += c * np.log(c)
    columns = [np.array([r[k] for r in rows]) for k in (0, 1, 2, 4, 5)] + [np.array([max(1, x) for x in col]) for col in ([total[r[3]] for r in rows], [same[r[3], r[5]] for r in rows], [styles[r[3]] for r in rows])]
    got = html_extract.branch_importance(*columns, np.array([entropy[r[3]] for r in rows], dtype=float))
    assert np.allclose(got, [expected[r[0], r[1]] for r in rows])


def brute_texts(rows):
    """Texts by the definition: style trees of whole hosts in dictionaries, branches weighed by recursion. rows: (page_id, url, html)."""
    hosts = {}
    for row in rows:
        root = html_extract.parse(row[2] or "")
        hosts.setdefault(brute_url(row[1])[0], []).append((row, root, html_extract.main_text(root)))
    out = []
    for host, own in hosts.items():
        nodes = [{r[0]: r for r in html_extract.style_rows(root, host)} for _, root, _ in own]
        met = {}  # bodies by place and value
        for (_, _, body), tree in zip(own, nodes, strict=True):
            for _, _, place, kind, value in tree.values():
                if kind in (html_extract.ELEMENT, html_extract.LEAF):
                    met.setdefault(place, {}).setdefault(value, set()).add(body)

        def weigh(tree, number, below):
            _, _, place, kind, value = tree[number]
            if kind == html_extract.FIXED:
                return float(value)
            if kind == html_extract.ARTICLE:
                own, styles = 1.0, 1
            else:
                counts = [len(x) for x in met[place].values()]
                m, styles = len(set().union(*met[place].values())), len(counts)
                if m < html_extract.MIN_PAGES or (kind == html_extract.LEAF and len(met[place][value]) == 1):
                    own = 1.0
                elif kind == html_extract.LEAF:
                    own = 1 - np.log(len(met[place][value])) / np.log(m)
                else:
                    own = (np.log(m) - sum(c * np.log(c) for c in counts) / m) / np.log(m)
            if not below[number] or kind == html_extract.LEAF:
                return own
            decay = html_extract.DECAY**styles
            return (1 - decay) * own + decay * np.mean([weigh(tree, c, below) for c in below[number]])

        for (row, root, _), tree in zip(own, nodes, strict=True):
            below = {n: [] for n in tree}
            for r in tree.values():
                if r[1] in below:
                    below[r[1]].append(r[0])
            free = (html_extract.ELEMENT, html_extract.LEAF)
            gone = set()
            for n in sorted(tree):  # parents come first
                if tree[n][3] in free and ((tree[n][1] >= 0 and weigh(tree, n, below) < html_extract.THRESHOLD) or tree[n][1] in gone):
                    gone.add(n)
            out.append((row[0], row[1], html_extract.main_text(root, frozenset(n for n in gone if tree[n][3] == html_extract.LEAF))))
    return out


def neutral_pages(rng, n):
    """Pages of one host whose boilerplate carries no telling tag, class or id."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    bodies = [[" ".join(word() for _ in range(25)) for _ in range(rng.choice([2, 3, 4]))] for _ in range(n)]
    page = lambda i, t: f"<div class=a1><p>Good prices every day</p></div><div class=a2>{'<article>' if i % 2 else '<div>'}{''.join(f'<p>{x}</p>' for x in t)}<p>Write to our desk</p>{'</article>' if i % 2 else '</div>'}</div><div class=a3>{'<p>Terms hold</p>' * (1 + i % 2)}</div>"
    return bodies, [(i, f"http://plain.org/{i}", page(i, t)) for i, t in enumerate(bodies)]


def test_whole_query_equals_brute_force(spark, sf_dir):
    _, rows = neutral_pages(random.Random(7), 40)
    rows += [(1000 + r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()] + rows[:3] + [(2000, None, None), (2001, "x", "")]
    found = [(r.page_id, r.url, r.text) for r in html_extract.extract_pages(pages(spark, rows)).collect()]
    order = lambda r: (r[0], r[2])
    assert sorted(found, key=order) == sorted(brute_texts(rows), key=order)


def test_noise_without_telling_names_goes_by_the_tree_alone(spark):
    bodies, rows = neutral_pages(random.Random(8), 40)
    found = {r.page_id: r.text for r in html_extract.extract_pages(pages(spark, rows)).collect()}
    assert [found[i] for i in range(40)] == ["\n".join(t) for t in bodies]
    assert all("Write to our desk" in html_extract.extract(h) for _, _, h in rows)  # a page alone can't tell


def test_deep_and_wide_pages_take_linear_time(spark):
    import time

    deep, wide = "<div>" * 40_000 + "x" + "</div>" * 40_000, "<p>" + "a <b>b</b> &amp; " * 60_000
    began = time.time()
    assert html_extract.extract(deep) == "x" and len(html_extract.extract(wide)) > 300_000
    assert html_extract.extract("<nav>" + "<div>" * 40_000 + "</i></div>" * 40_000 + "</nav>y") == "y"
    rows = [(i, f"http://deep.org/{i}", deep) for i in range(3)]
    assert [r.text for r in html_extract.extract_pages(pages(spark, rows)).collect()] == ["x"] * 3
    assert time.time() - began < 60


CHAT = "conv_id long, turn long, role string, text string, level string, id string"


def chat(spark, rows):
    return spark.createDataFrame([(*r, "l", "i") for r in rows], CHAT)


def call(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a, **({"depends_on": d} if d else {})} for i, n, a, d in calls]})


def result(call_id, content="x"):
    return json.dumps({"tool_call_id": call_id, "content": content})


def test_tool_calls_are_linked_ordered_validated_and_serialised(spark):
    rows = [
        (1, 0, "user", "find é \"x\""),
        (1, 1, "assistant", call(("c2", "weather", {"city": 7}, ["c1"]), ("c1", "search", {"query": "x", "limit": 3}, None))),
        (1, 2, "tool", result("c2", "plain")),
        (1, 3, "tool", result("c1", '{"b": 1, "a": [1, 2]}')),
        (1, 4, "tool", result("none")),
        (1, 5, "assistant", "done"),
        (2, 0, "assistant", call(("c1", "send_mail", {"to": "p"}, ["c9"]), ("c9", "nope", {}, ["c1"]))),
        (2, 1, "tool", '{"tool_call_id": "c1"'),
        (2, 2, "tool", result("c9")),
        (3, 0, "assistant", call(("a", "search", {"query": "x"}, ["gone"]))),
        (None, 0, "user", None),
        (4, None, "assistant", call(("a", "search", {"query": "x"}, None))),
    ]
    out = {(r.conv_id, r.turn): r for r in tool_chat.format_chat(chat(spark, rows), tool_chat.schema_table(spark)).collect()}
    assert len(out) == len(rows)
    assert out[1, 0].message == '{"content":"find é \\"x\\"","role":"user"}'
    assert out[1, 1].message == '{"role":"assistant","tool_calls":[{"arguments":{"limit":3,"query":"x"},"id":"c1","name":"search"},{"arguments":{"city":7},"id":"c2","name":"weather"}]}'
    assert (out[1, 1].n_calls, out[1, 1].n_valid) == (2, 1)
    assert (out[1, 3].links_to, out[1, 3].message) == (1, '{"content":{"a":[1,2],"b":1},"role":"tool","tool_call_id":"c1"}')
    assert (out[1, 2].links_to, out[1, 2].message) == (1, '{"content":"plain","role":"tool","tool_call_id":"c2"}')
    assert [turn for turn in sorted(range(6), key=lambda t: out[1, t].position)] == [0, 1, 3, 2, 4, 5]
    assert out[1, 4].links_to is None and out[1, 5].links_to is None and all(out[1, t].ordered for t in range(6))
    assert (out[2, 0].n_calls, out[2, 0].n_valid, out[2, 0].ordered, out[2, 0].position) == (2, 0, True, 0)
    assert (out[2, 2].links_to, out[2, 2].ordered) == (0, False)
    assert out[2, 1].message == '{"content":"{\\"tool_call_id\\": \\"c1\\"","role":"tool"}'
    assert (out[3, 0].ordered, out[3, 0].n_valid) == (True, 1)
    assert out[None, 0].message == '{"content":null,"role":"user"}'
    assert out[4, None].position is None


def test_positions_are_a_linear_extension_of_random_graphs(spark):
    rng = random.Random(9)
    rows, before = [], []
    for conv in range(60):
        n = rng.randrange(2, 9)
        ids = [f"c{i}" for i in range(n)]
        depends = {c: [ids[j] for j in range(i) if rng.random() < 0.3] for i, c in enumerate(ids)}
        # neighbours in the order of dependence share messages, so no circle of messages arises
        messages, left = [], list(ids)
        while left:
            take = rng.randrange(1, 4)
            messages.append(left[:take])
            left = left[take:]
        items = [("m", tuple(m)) for m in messages] + [("r", c) for c in ids if rng.random() < 0.85] + [("u", k) for k in range(3)]
        rng.shuffle(items)
        turn = {x: t for t, x in enumerate(items)}
        for x, t in turn.items():
            if x[0] == "m":
                own = list(x[1])
                rng.shuffle(own)
                rows.append((conv, t, "assistant", call(*((c, "search", {"query": "x"}, depends[c]) for c in own))))
            else:
                rows.append((conv, t, "tool" if x[0] == "r" else "user", result(x[1]) if x[0] == "r" else "text"))
        of = {c: ("m", tuple(m)) for m in messages for c in m}
        for c in ids:
            for first, then in [(of[c], ("r", c)), *((y, x) for d in depends[c] for y in (("r", d), of[d]) for x in ((of[c], ("r", c)) if of[c] != of[d] else (("r", c),)))]:
                if first in turn and then in turn:
                    before.append((conv, turn[first], turn[then]))
    out = {(r.conv_id, r.turn): r for r in tool_chat.format_chat(chat(spark, rows), tool_chat.schema_table(spark)).collect()}
    assert len(before) > 300 and all(r.ordered for r in out.values())
    assert all(out[c, a].position < out[c, b].position for c, a, b in before)
    moved = {(c, b) for c, a, b in before if a > b}
    still = [(c, t) for (c, t), r in out.items() if r.position == t << tool_chat.STEP_BITS]
    assert moved and {k for k in out} - set(still) >= moved  # and what no call concerns stays where it is
    assert all((r.conv_id, r.turn) in still for r in out.values() if r.role == "user")
    for r in out.values():
        if r.n_calls:
            told = [c["id"] for c in json.loads(r.message)["tool_calls"]]
            source = {c["id"]: c.get("depends_on", []) for c in json.loads(next(x[3] for x in rows if x[:2] == (r.conv_id, r.turn)))["tool_calls"]}
            assert all(d not in told or told.index(d) < told.index(c) for c, own in source.items() for d in own)


def test_plain_turns_link_to_the_turn_before(spark):
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(6)] + [(7, 1, "assistant", "m1")]
    out = tool_chat.format_chat(chat(spark, rows), tool_chat.schema_table(spark))
    assert sorted((r.turn, r.links_to) for r in out.collect() if r.role == "assistant") == [(1, 0), (1, 0), (3, 2), (5, 4)]
    assert tool_chat.format_chat(chat(spark, []), tool_chat.schema_table(spark)).count() == 0


def test_chat_stays_in_dataframe_functions(spark):
    out = tool_chat.format_chat(chat(spark, [(1, 0, "user", "x")]), tool_chat.schema_table(spark))
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    schemas = tool_chat.schema_table(spark)
    assert "ExistingRDD" not in schemas._jdf.queryExecution().toString()  # rows from a Python list would be one
    assert sorted(map(tuple, schemas.collect())) == sorted(tool_chat.SCHEMAS) and tool_chat.schema_table(spark, ()).collect() == []
    assert out.select(F.count("*")).first()[0] == 1
