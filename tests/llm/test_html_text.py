import numpy as np
import pytest

from quotelake.llm.html_text import blocks, divided, main_text, suffix_intervals

SCHEMA = "page_id long, url string, html string, text string, key string"


def text(page):
    return [t for _, t in divided(blocks(page))[0]]


@pytest.mark.parametrize(
    "page, want",
    [
        ("", []),
        ("<", ["<"]),
        ("<a title='", []),
        ("a < b <!-- no --> c<script>if (a</b) '</p>'</script> d", ["a < b c d"]),
        ("<nav>menu</nav><article><h1>A &amp B</h1><p><b>one<br><p>two&nbsp;\n x</article><footer>f</footer>", ["A & B", "one", "two x"]),
        ("<article><header><h1>Head</h1>by me</header><p>text</p><div class='comments'><article>nice</article></div></article>", ["Head", "text"]),
        ("<article>text<section id=comments><article class=comment>hi</article></section></article><article class='comment'>no</article>", ["text"]),
        ("<body class='has-sidebar'><header><h1>Site</h1></header><div id=content><p>one<p>two<table><tr><td>a<td>b</table></div><div class=sidebar>s</div>rest", ["one", "two", "a", "b"]),
        ("<main><p>x <span class=ad>buy <b>now</b></span> y</p><p class='cookie-notice'>c<p>z</main>", ["x y", "z"]),
        ("<b><div class=advert>x</b> y</div>z", ["z"]),
        ("<p title=it's>hello</p> <P HIDDEN>no</P><p style='display: none'>no</p><form>f</form>", ["hello"]),
        ("<aside><article>teaser</article></aside><div role=main><h2>T</h2>body<ul><li>1<li>2</ul></div>", ["T", "body", "1", "2"]),
        ("<p>" + "<i>" * 3000 + "deep" + "</div>" * 3000, ["deep"]),
    ],
)
def test_blocks(page, want):
    assert text(page) == want


def test_suffix_intervals_against_sorting():
    rng = np.random.default_rng(3)
    for _ in range(20):
        tokens = rng.integers(0, 3, rng.integers(1, 60))
        order, starts = suffix_intervals(tokens, 4)
        heads = [tuple(tokens[i : i + 4]) for i in order]
        assert heads == sorted(heads)
        assert [heads[i] for i in starts.tolist()] == sorted(set(heads))


def brute(rows, run=8, least=3):
    """Runs of unmarked pages counted one by one."""
    seen = {}
    for _, url, page in rows:
        words = " ".join(t for _, t in divided(blocks(page))[1]).split(" ")
        for i in range(len(words) - run + 1):
            seen.setdefault((url.split("/")[2], *words[i : i + run]), set()).add(" ".join(words))
    out = {}
    for i, url, page in rows:
        main, others = divided(blocks(page))
        if not main or any(level == 3 and not c for level, c, _ in blocks(page)):
            out[i] = "\n".join(t for _, t in main)
            continue
        words = [(n, w) for n, t in others for w in t.split(" ")]
        gone = set()
        for a in range(len(words) - run + 1):
            if len(seen[(url.split("/")[2], *(w for _, w in words[a : a + run]))]) >= least:
                gone |= set(range(a, a + run))
        lines = [" ".join(w for k, (m, w) in enumerate(words) if m == n and k not in gone) for n, _ in main]
        out[i] = "\n".join(x for x in lines if x)
    return out


def test_host_boilerplate_goes_and_unique_runs_stay(spark):
    menu = "Home News Sports Weather Markets Opinion Archive Contact Imprint"
    foot = "All rights reserved by the publisher of this paper since long ago"
    rows = []
    for i in range(40):
        host = "a.example" if i % 3 else "b.example"
        body = " ".join(f"w{(i * 7 + k * k) % 61}" for k in range(30))
        tail = foot if i % 2 else f"{foot} {body[:20]}"
        rows.append((i, f"https://{host}/{i}", f"<div>{menu}</div><p>{body}</p><p>{tail}</p>"))
    rows += [(100, "https://a.example/x", f"<article><p>{foot}</p></article><div>{menu}</div>"), (101, "https://c.example/x", f"<p>{foot}</p>")]
    rows += [(i, "https://d.example/x", f"<p>{foot}</p><p>same page again</p>") for i in range(200, 205)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    got = {r.page_id: r for r in main_text(df).collect()}
    want = brute(rows)
    assert {i: r.text for i, r in got.items()} == want
    assert menu not in want[0] and foot not in want[1] and want[100] == foot and want[101] == foot and foot in want[200]
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, None, None), (None, "http://h/1", "<p>x"), (2, "http://h/2", ""), (3, "h", "<p>" + "long " * 60000), (3, "h", "<p>" + "long " * 60000)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    got = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in main_text(df).select("page_id", "url", "text", "n_chars").collect())
    long = " ".join(["long"] * 60000)
    assert got == [(0, "http://h/1", "x", 1), (1, None, "", 0), (2, "http://h/2", "", 0), (3, "h", long, len(long)), (3, "h", long, len(long))]
    assert main_text(df.limit(0)).collect() == []
