import time

from narrata.operators import articles as A

LONG = " ".join(f"word{i}" for i in range(90))
PAGE = f"""<html><head><title>Tab</title><meta property="og:title" content=" Meta title "><meta name="author" content="Ann"></head>
<body><time datetime="2024-05-06">May</time><div class="content"><p>{LONG}<script>no()</script></p></div><p>One</p></body></html>"""


def test_places():
    root = A.tree_of(PAGE)
    assert (A.title_of(root), A.author_of(root), A.date_of(root)) == ("Meta title", "Ann", "2024-05-06")
    assert A.body_of(root) == LONG
    short = A.tree_of("<body><main><h1>In <b>main</b></h1></main><h1>Other</h1><p>a</p><p>b</p><p>c<br>d</p><span class='x byline'>By Bo</span></body>")
    assert (A.title_of(short), A.body_of(short), A.author_of(short)) == ("In main", "a\n\nb\n\nc d", "By Bo")
    assert A.title_of(A.tree_of("")) == "Untitled" and A.body_of(A.tree_of("<body>x<p>y")) == "x\ny"
    assert A.linked_data_body(['{"a":[{"articleBody":"x"}],"articleBody":" y "}', "{"]) == "y\n\nx"


def test_table(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string")
    rows = {r.page_id: r for r in A.article_table(df).collect()}
    assert rows[1].title == "Meta title" and rows[1].word_count == 90 and rows[2].content == ""


def test_deep_pages_and_data():
    html = "<body>" + "<li>x" * 5000 + "<article>" + "<div>" * 3000 + LONG
    root = A.tree_of(html)
    assert A.body_of(root) == LONG and A.title_of(root) == "Untitled"
    deep = '{"a":' * 900 + '{"articleBody":"in"}' + "}" * 900
    assert A.linked_data_body([deep, "[" * 100_000, '{"articleBody":"next"}']) == "in\n\nnext"


def test_time_of_deep_pages_and_stray_ends_grows_with_their_length():
    began = time.process_time()
    root = A.tree_of("<div><h1>" * 100_000)
    assert A.select(root, "article h1") is None and A.select(root, "div h1").name == "h1"
    root = A.tree_of("<li>" * 100_000 + "</x>" * 100_000 + "end")
    assert A.select(root, "li").name == "li"
    assert time.process_time() - began < 8


def test_outer_tests_in_order():
    root = A.tree_of("<main><article><p class='a'>x</p></article><h1>1</h1></main><article><div><h1>2</h1></div></article>")
    assert A.select(root, "article h1").text("") == "2" and A.select(root, "main article .a").text("") == "x" and A.select(root, "article main p") is None
