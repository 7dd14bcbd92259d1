"""Pages made by rule from layouts and sayings that the composer of op4 does not know, and hostile markup."""

import random
import time

import pytest

from ledgerspark.llm import extract

TEXTS = [
    ["How the harbour was dredged", "The first barges arrived in the spring of that year, when the water was still high.", "Nobody had measured the channel since the war, so the pilots relied on memory.", "By October the new quay stood finished, and the old sheds were pulled down.", "Some of the timber went into the schoolhouse, where it can be seen to this day."],
    ["Configuring the scheduler", "The scheduler reads its settings once at start and keeps them until it is stopped.", "Set the interval to a value between one and sixty seconds; shorter intervals cost more power.", "If a job fails, it is tried again after a pause that doubles each time.", "Logs are written to the folder named in the settings."],
    ["A soup for cold evenings", "Chop the onions finely and let them soften in butter over a low flame.", "Add the carrots, the celery and a litre of stock, then simmer for half an hour.", "Season with pepper only at the end, since the stock is salty enough.", "Serve it with dark bread."],
    ["Die Brücke am alten Markt", "Im Frühjahr wurde die Brücke für Fußgänger wieder freigegeben, nachdem sie zwei Jahre gesperrt war.", "Die Kosten stiegen während der Arbeiten auf mehr als das Doppelte der ersten Schätzung.", "Viele Anwohner hatten sich an den Umweg gewöhnt.", "Am Sonntag wird gefeiert."],
    ["Le vieux moulin", "Le moulin tournait encore au début du siècle, quand la rivière portait assez d'eau.", "Un incendie détruisit la roue, et personne ne voulut la réparer.", "Aujourd'hui les enfants du village y jouent en été.", "On y trouve parfois des pièces de cuivre."],
    ["Notes on the spring census", "Volunteers counted herons along forty kilometres of river during three mornings.", "Numbers fell for the second time in a row, although the nests were well hidden.", "Cold nights in March may explain a part of the loss.", "The next count is planned for autumn."],
]
BRAND = ["Acme", "Northwind", "Kestrel", "Blaufeld", "Orbis", "Tamarind"]


def page(layout, k):
    """(html, lines of the main text, lines of all else)."""
    title, *body = TEXTS[k]
    brand = BRAND[k]
    p = "".join(f"<p>{b}</p>" for b in body)
    top = f"{brand} | Pricing | Log in"
    legal = f"Copyright 2024 {brand} Ltd. All rights reserved."
    cookies = f"We use cookies to make {brand} better. Accept"
    letter = "Subscribe to our newsletter and never miss an update."
    menu = ["Overview", "Guides", "Reference", "Changelog"]
    links = "".join(f"<li><a href=/{m.lower()}>{m}</a></li>" for m in menu)
    good = [title, *body]
    if layout == "docs":
        return f"<body><div class=topbar>{top}</div><div class=sidenav><ul>{links}</ul></div><div class=doc-content><h1>{title}</h1>{p}</div><div class=pagefoot><p>{legal}</p></div></body>", good, [top, *menu, legal]
    if layout == "comments":
        said = ["I was there that year, it was colder than they say.", "Thanks for writing this up!"]
        return f"<body><article><h1>{title}</h1>{p}</article><section class=comments><h3>2 comments</h3>" + "".join(f"<div class=comment><p>{c}</p></div>" for c in said) + f"</section><footer>{legal}</footer></body>", good, ["2 comments", *said, legal]
    if layout == "cookies":
        return f"<body><div class=cookie-bar><p>{cookies}</p></div><nav><ul>{links}</ul></nav><main><h1>{title}</h1>{p}</main><div class=signup-box><p>{letter}</p></div></body>", good, [cookies, *menu, letter]
    if layout == "advert":
        ad = "Save 50% on shoes today only!"
        half = len(body) // 2
        inner = "".join(f"<p>{b}</p>" for b in body[:half]) + f"<div class=promo-box>{ad}</div>" + "".join(f"<p>{b}</p>" for b in body[half:])
        return f"<body><header>{top}</header><article><h1>{title}</h1>{inner}</article><footer><a href=/>Back to index</a></footer></body>", good, [top, ad, "Back to index"]
    if layout == "code":
        code = "run --every 5 --log /var/jobs"
        return f"<body><nav class=top/><ul>{links}</ul></nav><main><h1>{title}</h1>{p}<pre>{code}</pre></main><footer>{legal}</footer></body>", [*good, code], [*menu, legal]
    if layout == "table":
        rows = [("Year", "Count"), ("2021", "412"), ("2022", "377")]
        table = "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"
        return f"<body><header><a href=http://x.com/>{brand} home</a></header><article><h1>{title}</h1>{p}{table}</article><aside><h4>Most read</h4><ul>{links}</ul></aside></body>", [*good, *(c for r in rows for c in r)], [f"{brand} home", "Most read", *menu]
    if layout == "script":
        return f"<body><nav><ul>{links}</ul></nav><article><h1>{title}</h1>{p}<script src=x />var tracker=\"abc\"; send(tracker);</script></article><form><label>Your e-mail</label><input></form></body>", good, [*menu, "Your e-mail", 'var tracker="abc"; send(tracker);']
    raise ValueError(layout)


LAYOUTS = ("docs", "comments", "cookies", "advert", "code", "table", "script")


@pytest.fixture(scope="module")
def labeller(spark):
    return extract.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_unseen_layouts(labeller):
    pages = [page(layout, k) for layout in LAYOUTS for k in range(len(TEXTS))]
    assert len(pages) >= 40
    got = [t.split("\n") if t else [] for t in extract.extract_text([html for html, *_ in pages], labeller)]
    hit = sum(len(set(g) & set(good)) for g, (_, good, _) in zip(got, pages, strict=True))
    kept, wanted = sum(map(len, got)), sum(len(good) for _, good, _ in pages)
    wrong = sorted({x for g, (_, good, _) in zip(got, pages, strict=True) for x in g if x not in good})
    lost = sorted({x for g, (_, good, _) in zip(got, pages, strict=True) for x in good if x not in g})
    print(hit / kept, hit / wanted, wrong, lost)
    assert hit / kept >= 0.95, wrong
    assert hit / wanted >= 0.98, lost
    assert not any("tracker" in x for g in got for x in g)


def test_slashes_do_not_close():
    read = lambda html: extract.blocks(html)
    menu = read("<nav class=top/><ul><li>Menu</ul></nav><p>x")
    assert [b[0] for b in menu] == ["Menu", "x"] and "nav" in menu[0][1] and "nav" not in menu[1][1]
    assert read("<p><a href=http://x.com/>Home</a>")[0][2] == 1.0
    assert [b[0] for b in read("<article><p>a</p><script src=x />var t=1;</script><p>b</article>")] == ["a", "b"]
    assert [b[0] for b in read("<p>a<br/>b<hr/>c<svg><title/><path d=M/><style/></svg>d")] == ["a", "b", "c d"] or [b[0] for b in read("<p>a<br/>b<hr/>c<svg><title/><path d=M/><style/></svg>d")][-1].endswith("d")
    assert [b[0] for b in read("<div/><p>x</div>y")] == ["x", "y"]


def test_deep_pages_take_linear_time():
    def took(n, html):
        began = time.time()
        found = extract.blocks(html(n))
        return time.time() - began, found

    for html in (lambda n: "<span>x" * n, lambda n: "<div>x " * n, lambda n: "<svg><p>" * n + "x" * 10, lambda n: "<b><p>x" * n + "</b>" * n, lambda n: "<div class=c%d>x" * 1 % 7 + "".join(f"<div class=q{i}z>x" for i in range(n))):
        took(1000, html)
        t, found = took(100_000, html)
        assert t < 30 and sum(b[0].count("x") for b in found) >= 0
        assert sum(len(b[1]) for b in found) < 60_000_000
    text = "".join(b[0] for b in extract.blocks("<div>x" * 50_000))
    assert text.count("x") == 50_000  # nothing is lost beyond the depth that is kept


def test_random_markup_never_fails(labeller):
    rng = random.Random(8)
    bits = ["<div", "<p>", "</p>", "<a href=x/>", "<svg>", "</svg>", "<script>", "</script>", "/>", ">", "<", "text ", "&amp;", "<!--", "-->", "<option>", "<button>", "</div>", "\x00", "é", '"', "'", "<td>", "<br/>"]
    pages = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(400)] + [None, ""]
    got = extract.extract_text(pages, labeller)
    assert len(got) == len(pages) and got[-2:] == ["", ""] and got == extract.extract_text(pages, labeller)
