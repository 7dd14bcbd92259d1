"""Hand-labelled pages of many layouts: (name, html, main text). Made for these tests; nothing is learned from them."""

P1 = "The city council met on Tuesday evening and agreed to repair the old bridge before winter."
P2 = "Work will begin in May, the mayor said, and traffic will use the northern road until autumn."
P3 = "Residents had asked for years that the crossing be made safe for children on their way to school."
H = "Old bridge to be repaired"
ALL = "\n".join((H, P1, P2, P3))
MENU = "<a href=/>Home</a> <a href=/n>News</a> <a href=/s>Sport</a> <a href=/c>Contact</a>"

LAYOUTS = [
    ("article", f"<nav>{MENU}</nav><article><h1>{H}</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></article><footer>&copy; 2020 The Paper</footer>", ALL),
    ("nested divs", f"<div class=x1><h1>{H}</h1><div>{P1}</div><div>{P2}</div><div>{P3}</div></div>", ALL),
    ("divs with menu", f"<div class=k9><ul><li><a href=/>Home</a><li><a href=/n>News</a><li><a href=/s>Sport</a></ul></div><div class=k2><h1>{H}</h1><div>{P1}</div><div>{P2}</div><div>{P3}</div></div><div class=k7>&copy; 2020 The Paper</div>", ALL),
    ("unnamed divs", f"<div><div>{MENU}</div><div><h2>{H}</h2><p>{P1}</p><p>{P2}</p><p>{P3}</p></div><div><a href=/i>Imprint</a> <a href=/p>Privacy</a></div></div>", ALL),
    ("table layout", f"<table><tr><td colspan=2>{MENU}</td></tr><tr><td><a href=/>Home</a><br><a href=/n>News</a><br><a href=/a>Archive</a></td><td><h1>{H}</h1><p>{P1}<p>{P2}<p>{P3}</td></tr><tr><td colspan=2>&copy; 2020 The Paper</td></tr></table>", ALL),
    ("text cells", f"<table width=100%><tr><td><a href=/>Home</a></td><td><font size=5>{H}</font><br>{P1}<br><br>{P2}<br><br>{P3}</td></tr></table>", ALL),
    ("line breaks", f"<body><center>{MENU}</center><h1>{H}</h1>{P1}<br><br>{P2}<br><br>{P3}<hr><center><a href=/up>Up</a></center></body>", ALL),
    ("bare paragraphs", f"<h1>{H}</h1><p>{P1}<p>{P2}<p>{P3}", ALL),
    ("named divs", f"<div id=header>{MENU}</div><div id=content><h1>{H}</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></div><div id=sidebar><h3>Most read</h3><ul><li><a href=/1>Storm over the coast</a><li><a href=/2>Team wins again</a></ul></div><div id=footer>All rights reserved.</div>", ALL),
    ("comments inside", f"<article><h1>{H}</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p><div class=comments><h3>2 comments</h3><div class=comment><p>I have waited for this since I was a child, well done to all.</p></div><div class=comment><p>They should have done it ten years ago, and it will cost twice as much.</p></div></div></article>", ALL),
    ("cookie notice", f"<div class=cookie-notice><p>We use cookies to give you the best experience on our site. Read more in our policy.</p><button>Accept</button></div><main><h1>{H}</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></main>", ALL),
    ("newsletter inside", f"<main><h1>{H}</h1><p>{P1}</p><div class=newsletter><p>Sign up for our daily letter and read all news first.</p><form><input><button>Go</button></form></div><p>{P2}</p><p>{P3}</p></main>", ALL),
    ("list in text", f"<div class=c><h1>{H}</h1><div>{P1}</div><ul><li>{P2}<li>{P3}</ul></div><div class=d>{MENU}</div>", ALL),
    ("menu only", f"<div class=a>{MENU}</div><div class=b><a href=/i>Imprint</a></div>", ""),
]
