"""The extractor's contract on small pages, its ratios against plain loops, and pages that are made to be slow."""

import math
import random
import time

import numpy as np
import pytest

from waymark.llm.extract import PUNCTUATION, content_blocks, main_text, path_scores

LONG = "This is a long sentence, with commas, and so on. " * 12


def test_title_lead_and_last_part_belong_to_the_article():
    page = f"<div id=wrap><h1>Title</h1><div class=lead><p>Lead, first.</p></div><div class=a>{LONG}</div><div class=b>short</div></div>"
    assert content_blocks(page) == ["Title", "Lead, first.", LONG.strip(), "short"]


def test_sentences_about_copyright_stay_and_notices_go():
    page = f"<body><h1>T</h1><p>{LONG}</p><p>{LONG}</p><p>%s</p></body>"
    assert content_blocks(page % "Copyright law changed in 1976.")[-1] == "Copyright law changed in 1976."
    for notice in ("Copyright 2024 Someone", "© 2024 Someone", "All rights reserved."):
        assert content_blocks(page % notice) == ["T", LONG.strip(), LONG.strip()]


@pytest.mark.parametrize("heading", ["Reader comments", "Comments (12)", "3 comments", "Kommentare", "Commentaires"])
def test_parts_headed_as_comments_go(heading):
    part = f"<section class='reactions'><h2>{heading}</h2><p>{LONG}</p><p>nice one</p></section>"
    assert content_blocks(f"<body><article><h1>T</h1><p>{LONG}</p>{part}<p>End.</p></article></body>") == ["T", LONG.strip(), "End."]
    assert content_blocks(f"<body><article><h1>T</h1><section><h2>{heading} on the law</h2><p>{LONG}</p></section></article></body>")[1] == f"{heading} on the law"


def test_only_comments_give_no_text():
    assert main_text(f"<div><div><h2>Comments</h2><p>{LONG}</p></div></div>") == ""


@pytest.mark.parametrize("seed", range(5))
def test_path_scores_equal_plain_loops(seed):
    rng = random.Random(seed)
    n, size = rng.randint(1, 6), rng.randint(1, 30)
    of, texts, free = [rng.randrange(n) for _ in range(size)], ["".join(rng.choice("ab .,!") for _ in range(rng.randint(1, 40))) for _ in range(size)], [rng.random() for _ in range(size)]
    means = []
    for value in (len, lambda t: len(PUNCTUATION.findall(t)) + 1):
        per = {p: sum(value(t) * f for q, t, f in zip(of, texts, free, strict=True) if q == p) / max(1, of.count(p)) for p in range(n)}
        series = [per[p] for p in of]
        series = [series[0], *series, series[-1]]
        means.append([0.1 * series[i] + 0.8 * series[i + 1] + 0.1 * series[i + 2] for i in range(size)])
    want = [0.0] * n
    for p in range(n):
        own = [i for i in range(size) if of[i] == p]
        if own:
            want[p] = sum(math.sqrt(means[0][i] * means[1][i]) * len(texts[i]) for i in own) / sum(len(texts[i]) for i in own)
    score, text = path_scores(np.array(of), texts, np.array(free), n)
    assert np.allclose(score, want) and np.allclose(text, [sum(len(t) * f for q, t, f in zip(of, texts, free, strict=True) if q == p) for p in range(n)])


@pytest.mark.parametrize("page", ["<i><div>" + "<b>" * 130_000 + "</i>" * 130_000, "<p>" * 300_000, "<div>" * 180_000 + "</b>" * 100_000, "<a>" * 200_000 + "</div>" * 60_000])
def test_work_is_in_proportion_to_the_page(page):
    began = time.perf_counter()
    content_blocks(page)
    assert time.perf_counter() - began < 30
