import pytest

from testlog.llm import htmltext as h

LONG = "The rain of the year and the wind that is in the hills for a long time was the talk of it " * 3


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("plain words", "plain words"),
        ("<p>a &amp; b&nbsp;c<br>d</p>", "a & b c d"),
        ("<article><h1>T</h1><p>x</p></article><footer>f</footer>", "T\n\nx"),
        ("<header>Site</header><main><header><h1>T</h1></header><p>x<p>y</main>", "T\n\nx\n\ny"),
        ("<nav><ul><li><a href=/>Home</a></ul></nav><article><p>x</p>", "x"),
        ("<article><p>x</p><div class='reader-comments'><p>" + LONG + "</p></div><p>y</p></article>", "x\n\ny"),
        ("<div id=cookieNotice>" + LONG + "</div><p>" + LONG, LONG.strip()),
        ("<article><p>x</p><form><label>Mail</label><input></form><script>a<b</script><style>p{}</style></article>", "x"),
        ("<article><!-- <p>no</p> --><p>a < b and c > d</p></article>", "a < b and c > d"),
        ("<article><p title='a > b'>x</p><p hidden>h</p><p style='display: none'>n</p></article>", "x"),
        ("<body class='has-sidebar'><div class='content with-sidebar'><p>kept</p></div><aside>gone</aside></body>", "kept"),
        ("<p><a href=1>one</a> <a href=2>two</a></p><p>" + LONG + "</p>", LONG.strip()),
        ("<article><p>" + "#%& " * 90 + "</p></article>", ("#%& " * 90).strip()),
        ("<article><p>cut off in the mid", "cut off in the mid"),
        ("<article><p>x</p><p class=\"open>y</p>", "x\n\ny"),
    ],
)
def test_main_text(page, text):
    assert h.main_text(page)[0] == text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<html><head><title>\u0130zmir</title></head><body><article><p>x</p></article></body>", "x"),
        ("<article><p>\u0130</p><script>a</SCRIPT ><p>y</p><style>b</style\n></article>", "\u0130\n\ny"),
        ("<head><title>T</title><body><article><p>x</p><header><p>y</p></header></article>", "x\n\ny"),
        ("<article><svg><title>a</title></svgs></svg><p>x</p></article>", "x"),
    ],
)
def test_end_tags_of_unparsed_elements(page, text):
    assert h.main_text(page)[0] == text


RUSSIAN = "Дождь шёл весь год, и ветер на холмах долго был тем, о чём говорили все жители этой деревни. " * 3
LINKS = "<ul><li><a href=/1>one</a></li><li><a href=/2>two</a></li></ul>"


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<p>{RUSSIAN}</p>{LINKS}<p>{RUSSIAN}</p>", f"{RUSSIAN.strip()}\n\n{RUSSIAN.strip()}"),
        ("<div><p>First short.</p><p>Second short.</p><a href=/2>next page</a></div>", "First short.\n\nSecond short."),
        ("<article><h1>T</h1><p>Short.</p><p><a href=/s>Source</a></p></article>", "T\n\nShort."),
        (f"<article><h1><a href=/t>Title</a></h1><p>{LONG}</p></article>", f"Title\n\n{LONG.strip()}"),
        (f"<p>{LONG}</p><p>by me</p>{LINKS}", f"{LONG.strip()}\n\nby me"),
        (f"<p>{LONG}</p>{LINKS}<p>See <a href=/x>it</a> there now</p>{LINKS}", LONG.strip()),
        (f"<p>{LONG}</p><p>{'xq zz ' * 40}</p><p>ww</p>", LONG.strip()),
        ("<article><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p></article>", "so x=1 holds"),
        (f"<div class='page-widget-wrapper'><main><p>{LONG}</p></main><p>other</p></div>", LONG.strip()),
        ("<div class='post'><div class='entry-header'><h1>T</h1></div><p>x</p></div>", "T\n\nx"),
    ],
)
def test_no_page_with_content_comes_out_empty(page, text):
    assert h.main_text(page)[0] == text


@pytest.mark.parametrize(
    "name", ["sidebar-container", "ad-container", "cookie-banner-wrapper", "page-footer", "post-comments", "entry-footer"]
)
def test_marks_win_over_names_of_wrappers(name):
    assert h.main_text(f"<p>{LONG}</p><div class='{name}'><p>{LONG}</p><p>x</p></div>")[0] == LONG.strip()


def test_second_pass_takes_the_nearest_label_of_the_region():
    labels = [True, None, None, None, False, None, None, True]
    assert h.second_pass(labels, [0] * 8) == [True, True, True, False, False, False, True, True]
    assert h.second_pass([False, None, None], [1, 2, 2]) == [False, True, True]


def test_table(spark):
    rows = [(1, "u", "<p>x</p>", "old"), (1, "u", "<p>x</p>", "old"), (None, None, None, None), (3, "v", "<b>" * 20000 + "y", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = h.extract(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"]
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in out.collect()) == [(0, "", 0), (1, "x", 1), (1, "x", 1), (3, "y", 1)]
    assert h.extract(pages.limit(0)).count() == 0
