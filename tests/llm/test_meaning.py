"""Main text where article and main do not tell all."""

from tessera.llm import html_text

BODY = "".join(f"<p>A long paragraph, number {i}, with several words in it, and a stop.</p>" for i in range(8))


def test_teaser_articles_do_not_hide_the_text():
    teasers = "".join(f"<article><h3>Teaser {i}</h3></article>" for i in range(4))
    found = html_text.main_text(f"<body><div class='body'>{BODY}</div><div>{teasers}</div></body>")
    assert found.count("A long paragraph") == 8


def test_link_lists_in_main_go():
    links = "".join(f"<li><a href='/{i}'>link {i}</a></li>" for i in range(12))
    for around in ("main", "article"):
        found = html_text.main_text(f"<body><{around}>{BODY}<ul>{links}</ul></{around}></body>")
        assert found.count("A long paragraph") == 8 and "link" not in found


def test_short_boxes_in_main_go():
    boxes = "<div class='box'>x</div>" * 6
    found = html_text.main_text(f"<body><main>{BODY}<section>{boxes}</section></main></body>")
    assert found.count("A long paragraph") == 8 and not found.endswith(" x")
