"""Pages without article or main."""

import pytest

from encore.llm.extraction import main_text

TEXT = "<p>One, two, three, four.</p><p>Five, six, seven, eight, nine.</p>"
READ = "One, two, three, four.\nFive, six, seven, eight, nine."


@pytest.mark.parametrize("page, want", [
    (f"<body><h1>Title</h1><div>{TEXT}</div><blockquote>Said.</blockquote></body>", f"Title\n{READ}\nSaid."),
    (f"<body><h2><a href=x>Title</a></h2><div>{TEXT}</div><pre>code</pre><div>Leaf</div></body>", f"Title\n{READ}\ncode\nLeaf"),
    (f"<body><div>{TEXT}</div><section><p>Short</p></section></body>", f"{READ}\nShort"),
    (f"<body><div>{TEXT}</div>bare <b>text</b> here<div>{TEXT}</div></body>", f"{READ}\nbare text here\n{READ}"),
    (f"<body><ul><li><a href=x>Home</a></ul><div>{TEXT}</div><a href=y>More</a><div class=share-box>Share</div></body>", READ),
])
def test_siblings_of_the_container(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("wrapper", [
    "<div id=page class=sidebar-right>", "<div class=menu-open>", "<div class=nav-fixed>", "<div class=footer-sticky>",
    "<div role=form>", "<form>", "<div class=page><form id=aspnet>",
])
def test_wrappers_of_the_page_stay(wrapper):
    rest = "<div class=sidebar><p>Other, more</p></div><form><p>Write, now</p></form><div class=comments>" + "<p>So, so, so, so</p>" * 9
    assert main_text(f"<body>{wrapper}<nav>Home</nav><div>{TEXT}</div>{rest}</body>") == READ
    assert main_text(f"<body>{wrapper}<nav>Home</nav><article>{TEXT}</article>{rest}</body>") == READ
    assert main_text(f"<body><div>{TEXT}</div>{wrapper}<p>Short, this</p></body>").startswith(READ)


def test_hidden_parts_and_comments_go_at_any_share():
    assert main_text(f"<body><div hidden>{TEXT}</div><div class=comments>{TEXT}</div><p>One</p></body>") == "One"
    assert main_text(f"<body><article><p>One</p></article><div class=sidebar>{TEXT}</div></body>") == "One"
