import random
import time

from tallyforge.llm import pages


def test_generated_pages_held_out():
    rng = random.Random(99)
    t = time.time()
    boosted = pages.model()
    print("fit", time.time() - t)
    right = wrong = missed = 0
    for _ in range(150):
        page, content = pages.generate(rng)
        got, want = pages.texts([page], boosted)[0].split("\n"), [c for c in content if c in " ".join(page.split())]
        right += len(set(got) & set(want))
        wrong += len(set(got) - set(want))
        missed += len(set(want) - set(got))
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95, (right, wrong, missed)


def test_parsing_cases():
    boosted = pages.model()
    head = "<!DOCTYPE html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>Menu</a></li><li><a href=/b>More</a></li></ul></nav><article><h1>Head &amp; line</h1>"
    body = "<p><b>One  two\n three, four &lt;five&gt; six.<br><p>Next &eacute; paragraph here, long enough to be one.</p>"
    text = "Head & line\nOne two three, four <five> six.\nNext é paragraph here, long enough to be one."
    tail = "</article><footer>&copy; site &middot; all rights</footer></body></html>"
    assert pages.texts([head + body + tail, head + body, head + body + "<p cl", None, ""], boosted) == [text, text, text, "", ""]


def test_no_contradiction():
    import numpy as np

    parents = [-1, 0, 1, 1, 0, 4]
    keep = pages.decode(parents, np.array([0, -9.0, 2, 2, 1, -3]))
    assert keep.tolist() == [True, False, False, False, True, False]


def test_table(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    got = pages.main_texts(spark.createDataFrame([(1, "u", None, "x", 1), (None, None, "<article><p>Hello, this is some text of an article.</p></article>", "x", 1)], schema)).collect()
    assert [tuple(r) for r in got][0] == (1, "u", "", 0)
    assert got[1].n_chars == len(got[1].text)
    assert pages.main_texts(spark.createDataFrame([], schema)).count() == 0


def test_elements_without_end_tags():
    boosted = pages.model()
    para = "<p>This is a paragraph of the article, and it is long enough to be kept.</p>"
    text = "This is a paragraph of the article, and it is long enough to be kept."
    for before in ("<head><title>T</title><body>", "<head><title>T</title>", "<noscript>", "<body><svg>", "<head><meta charset=utf-8><template>", "<body><object data=x>"):
        assert pages.texts([f"<!DOCTYPE html><html>{before}<article>{para}{para}</article>"], boosted)[0] == f"{text}\n{text}", before
    closed = "<noscript>none of this</noscript><select><option>one<option>two</select>"
    assert pages.texts([f"<html><head></head><body><article>{para}{closed}{para}</article>"], boosted)[0] == f"{text}\n{text}"
    assert pages.texts([f"<article>{para}<script>var x = 1;"], boosted)[0] == text
    assert pages.texts([f"<article>{para}<datalist><option value=1>one</option><option>two {para}</article>"], boosted)[0] == f"{text}\n{text}"


def test_decoding_against_all_labellings():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(150):
        n = int(rng.integers(1, 10))
        parents = [-1, *[int(rng.integers(0, k)) for k in range(1, n)]]
        odds = rng.normal(-pages.MARGIN, 2, n)
        worth = odds + pages.MARGIN
        best = max(
            (sum(worth[k] for k in range(1, n) if kept[k - 1]) for kept in itertools.product([False, True], repeat=n - 1) if all(parents[k] == 0 or kept[parents[k] - 1] for k in range(1, n) if kept[k - 1])),
            default=0.0,
        )
        keep = pages.decode(parents, odds)
        assert keep[0] and all(keep[parents[k]] for k in range(1, n) if keep[k])
        assert abs(sum(worth[1:][keep[1:]]) - best) < 1e-9


def test_repeated_rows_and_long_pages(spark):
    para = "<p>This is a paragraph of the article, and it is long enough to be kept.</p>"
    long = f"<html><head><title>x</title></head><body><nav><a href=/>menu</a></nav><article>{para * 20_000}</article></body></html>"
    got = pages.main_texts(spark.createDataFrame([(1, "u", long), (1, "u", long)], "page_id long, url string, html string")).collect()
    assert got[0] == got[1] and got[0].text.count("\n") == 19_999


def test_page_wide_forms_and_titles_in_headers():
    boosted = pages.model()
    para = "<p>This is a paragraph of the article, and it is long enough to be kept, since it has some more words than a label.</p>"
    text = para[3:-4]
    menu = "<nav><ul><li><a href=/a>Menu</a></li><li><a href=/b>More</a></li></ul></nav>"
    foot = "<footer>&copy; site, all rights</footer>"
    search = '<form class="search"><label>Find</label><input name=q><button>Go</button></form>'
    for name in ('id="form1"', 'id="aspnetForm" class="form"', ""):
        page = f'<html><body><form method="post" {name}><input type=hidden name=s>{menu}{search}<article><h1>Title here</h1>{para}{para}</article>{foot}</form></body></html>'
        assert pages.texts([page], boosted)[0] == f"Title here\n{text}\n{text}", name
    page = f'<html><body>{menu}<article><header><h1>Title here</h1></header>{para}{para}</article>{foot}</body></html>'
    assert pages.texts([page], boosted)[0] == f"Title here\n{text}\n{text}"
    page = f'<html><body><header class="site-header"><h1>My site</h1><ul><li><a href=/a>Menu</a></li></ul></header><article><header class="entry-header"><h1>Title here</h1><p class="meta">By someone</p></header>{para}{para}</article>{foot}</body></html>'
    assert pages.texts([page], boosted)[0] == f"Title here\n{text}\n{text}"
    login = '<html><body><form class="login"><label>Name</label><input name=a><label>Word</label><input name=b><p>Forgot it?</p><button>Sign in</button></form></body></html>'
    assert pages.texts([login], boosted)[0] == ""
    page = f"<html><body>{menu}<article>{para}{para}</article>{search}</body></html>"
    assert pages.texts([page], boosted)[0] == f"{text}\n{text}"


def test_very_deep_nesting():
    boosted = pages.model()
    para = "<p>This is a paragraph of the article, and it is long enough to be kept, since it has some more words than a label.</p>"
    for tag, deep in (("div", 20_000), ("span", 20_000), ("font", 20_000), ("ul><li", 3_000), ("form", 3_000)):
        page = f"<html><body>{f'<{tag}>' * deep}<article>{para}{para}</article></body></html>"
        start = time.time()
        assert pages.texts([page], boosted)[0].split("\n") in ([para[3:-4]] * 2, [""]), tag
        assert time.time() - start < 20, tag
