import pytest

from furrow.llm import host_paths as op

BODY = "<p>First &amp; best   paragraph, with enough words.</p><p>Second<br>line of <b>text</b> &#8212; here.</p>"
WANT = "First & best paragraph, with enough words.\nSecond\nline of text — here."


def text(html, votes=None):
    return op.Page(html).text(votes or {})


@pytest.mark.parametrize(
    "html, want",
    [
        ("", ""),
        ("no tags at all", "no tags at all"),
        (f"<body><nav><a href=x>Menu</a></nav><article>{BODY}</article><footer>&copy; us</footer></body>", WANT),
        (f"<div class='sidebar'>Side</div><div id=main class='post-body'>{BODY}</div><div class='comments-12'><p>me too</p></div>", WANT),
        (f"<main><div class=cookie-notice>Cookies!</div>{BODY}<form>Mail <input name=a></form><aside>More</aside></main>", WANT),
        (f"<article><script>var a='<p>no</p>'</script><style>p{{}}</style><!-- <p>no</p> -->{BODY}<div hidden>no</div></article>", WANT),
        (f"<article>{BODY.replace('</p>', '')}", WANT),
        ("<article><p>a < b and c</p><p>3 &lt; 4</p></article>", "a < b and c\n3 < 4"),
        ("<article><p>x</p><!-- never ends <p>y</p>", "x"),
        ("<nav>only</nav><footer>boilerplate</footer>", ""),
        ("<article><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table></article>", "one\ntwo\nc1\nc2"),
        ("<a href='x>y'>link</a> <i>text</i>", "link text"),
    ],
)
def test_page(html, want):
    assert text(html) == want


def test_host_consensus(frame):
    """A page whose own choice differs follows the path that the host's pages agree on."""
    normal = "<body><div class='wrap-{0}'><div class=t>" + BODY + "</div><div class=x><p>Short.</p></div></div></body>"
    odd = "<body><div class='wrap-9'><div class=t><p>Real text.</p></div><div class=x><p>" + "Filler words go on. " * 40 + "</p></div></div></body>"
    rows = [(i, f"https://A.example.org/{i}", normal.format(i), "c") for i in range(5)] + [
        (9, "http://a.example.org:80/x", odd, "c"), (10, "https://other.org/", odd, "c"), (11, None, None, "c"), (12, "not a url", "", "c"), (0, "https://A.example.org/0", normal.format(0), "c")
    ]
    pages = frame(rows, "page_id long, url string, html string, votes string")
    found = op.extract(pages)
    assert found.columns == ["page_id", "url", "html", "votes", "text"]
    got = {r.page_id: r.text for r in found.collect()}
    assert found.count() == len(rows)
    assert got[0] == WANT and got[9] == "Real text." and got[10].startswith("Filler words") and got[11] == "" and got[12] == ""
    assert op.extract(pages.where("false")).count() == 0
    won = {r.host: r.votes for r in op.votes(pages).collect()}
    assert max(won["a.example.org"], key=won["a.example.org"].get) == "body/div.wrap-#/div.t"


LONG = "Words of the body go on and on. " * 30
NESTED = [
    (f"<body><article><h1>Head</h1><p>Lead.</p><div class=body><p>{LONG}</p></div></article></body>", f"Head\nLead.\n{LONG.strip()}"),
    (f"<body><main><div class=top><h1>Head</h1></div><article><div class=body><p>{LONG}</p></div></article></main></body>", f"Head\n{LONG.strip()}"),
    (f"<body><div class=post><h1>Head</h1><p>Lead.</p><div class=body><p>{LONG}</p></div></div></body>", f"Head\nLead.\n{LONG.strip()}"),
]


@pytest.mark.parametrize("html, want", NESTED)
def test_nested_body_keeps_headline_and_lead(html, want):
    assert text(html) == want


def test_mixed_templates(frame):
    """A page of a rarer template is not cut down to a small part that lies on the winning path; no template is too rare."""
    small = "<div class=t><p>Short note {0}.</p></div>"
    pages = [(i, f"<body><div class=t><p>Story {i}. {LONG}</p></div></body>", f"Story {i}. {LONG.strip()}") for i in range(9)]
    for kind in range(6):
        for page in range(2):
            i = 100 + 10 * kind + page
            pages.append((i, f"<body>{small.format(i)}<div class=k{'abcdef'[kind]}><p>Other {i}. {LONG}</p></div></body>", f"Other {i}. {LONG.strip()}"))
    pages += [(200, f"<body><div class=t><div class=in><p>{LONG}</p></div><p>Tail.</p></div></body>", f"{LONG.strip()}\nTail.")]
    pages += [(i, html, want) for i, (html, want) in enumerate(NESTED * 2, 300)]
    rows = [(i, "https://hot.example.org/x", html) for i, html, _ in pages]
    got = {r.page_id: r.text for r in op.extract(frame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: want for i, _, want in pages}


def test_query_reads_documents_back(spark, documents):
    """The pages hold documents under a headline; all white space but line ends is one space."""
    from furrow.llm.queries import op5_host_paths

    known = {"\n".join(x for x in (" ".join(line.split()) for line in r.text.split("\n")) if x) for r in documents.collect()}
    rows = op5_host_paths(spark, "/root/testdata/sf0.001").collect()
    assert all(r.n_chars == len(r.text) for r in rows)
    hits = sum(r.text.partition("\n")[2] in known for r in rows)
    assert hits >= 0.9 * len(rows), (hits, len(rows))
