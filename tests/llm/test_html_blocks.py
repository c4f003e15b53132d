"""Blocks of broken and terse markup, against the standard library's parser; decoding against all sequences of labels."""

import itertools
import random
import time
from html.parser import HTMLParser

import pytest

from quarry.llm import html_extract

SF = "/root/testdata/sf0.01"


class Words(HTMLParser):
    """The words outside of elements whose content is no text."""

    def __init__(self):
        super().__init__()
        self.out, self.words = [], []

    def handle_starttag(self, tag, attributes):
        if tag in html_extract.SKIPPED:
            self.out.append(tag)

    def handle_endtag(self, tag):
        if tag in self.out:
            while self.out.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.out:
            self.words.append(data)
        return super().handle_data(data)


def test_words_of_pages_equal_those_of_another_parser(spark):
    pages = [r[0] for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]
    assert len(pages) > 200
    for page in filter(None, pages):
        other = Words()
        other.feed(page)
        other.close()
        assert "".join("".join(b.text.split()) for b in html_extract.blocks(page)) == "".join("".join(other.words).split())


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<html><head><title>t</title><p>First paragraph <p>second", ["First paragraph", "second"]),
        ("<title>x</title><meta name=a><link rel=b>Text without <b>any</b> of the tags<p>more", ["Text without any of the tags", "more"]),
        ("<head><meta a=b> \n <title>no</title><style>p {}</style><div>in the body</div></head>still", ["in the body", "still"]),
        ("<head><svg><p>no</p></svg></head><body>yes", ["yes"]),
        ("<p title='a > b'>one</p><p title=\"it's\">two", ["one", "two"]),
        ("<p>a < b and c< d <!-- no <p>no --> e", ["a < b and c< d e"]),
        ("<p title=\"x>open quote <b>bold</b></p><p>next</p>", ["open quote bold", "next"]),
        ("<p>before<a", ["before<a"]),
        ("", []), (None, []), ("<", ["<"]), ("<!", ["<!"]), ("</", ["</"]),
    ],
)
def test_terse_and_broken_markup(page, texts):
    assert [b.text for b in html_extract.blocks(page)] == texts


def test_only_whole_attribute_names_tell():
    said = html_extract._said
    assert said(' title="hidden costs" data-hidden data-id="sidebar" alt=\'class="nav"\'') == (frozenset(), False)
    assert said(' data-x hidden ID=sidebar') == (frozenset({"side"}), True)
    assert said(' class="siteNav" style="color:red; display : none"') == (frozenset({"nav"}), True)
    assert said(' aria-hidden="false" class=post') == (frozenset({"content"}), False)


@pytest.mark.parametrize("unit", ["<a ", "<div>x", "<!", "<!--", "<a x\">\"", "<a '>'", "<svg>", "<script>", "<b></p>", "</button>", "&amp", "<a b=\" c"])
def test_time_is_in_proportion_to_length(unit):
    """A megabyte of broken markup; at quadratic time it would take hours."""
    began = time.process_time()
    html_extract.blocks("<body><svg>" * (unit == "</button>") + unit * (1_000_000 // len(unit)))
    assert time.process_time() - began < 30


def test_viterbi_finds_the_best_of_all_sequences():
    rng = random.Random(9)
    for _ in range(60):
        weights = tuple(rng.gauss(0, 1) for _ in html_extract.NAMES)
        steps = tuple(tuple(rng.gauss(0, 1) for _ in range(2)) for _ in range(2))
        found = [html_extract.Block("", rng.sample(range(len(weights)), 4)) for _ in range(rng.randrange(1, 9))]
        emit = [sum(weights[f] for f in b.features) for b in found]
        score = lambda labels: sum(e for e, y in zip(emit, labels) if y) + sum(steps[a][b] for a, b in itertools.pairwise(labels))
        best = max(itertools.product((0, 1), repeat=len(found)), key=score)
        assert tuple(html_extract.Model(weights, steps).decode(found)) == best


def test_fit_maximises_the_likelihood():
    """The likelihood by summing over all sequences falls wherever the fitted weights are moved."""
    import numpy as np

    rng = random.Random(2)
    pages = []
    for _ in range(12):
        n = rng.randrange(2, 6)
        labels = [rng.randrange(2) for _ in range(n)]
        pages.append(([html_extract.Block("", [0, 1 + y if rng.random() < 0.7 else 3]) for y in labels], labels))
    ridge = 1e-2
    model = html_extract.fit(pages, steps=1500, ridge=ridge)

    def likelihood(w, s):
        total = 0.0
        for found, labels in pages:
            emit = [sum(w[f] for f in b.features) for b in found]
            score = lambda ys: sum(e for e, y in zip(emit, ys) if y) + sum(s[a][b] for a, b in itertools.pairwise(ys))  # noqa: B023, E731
            total += score(labels) - np.logaddexp.reduce([score(ys) for ys in itertools.product((0, 1), repeat=len(found))])
        return total / sum(len(y) for _, y in pages) - ridge / 2 * (sum(x * x for x in w) + sum(x * x for r in s for x in r))

    best = likelihood(model.weights, model.steps)
    for k in range(4):
        for by in (-0.2, 0.2):
            moved = list(model.weights)
            moved[k] += by
            assert likelihood(moved, model.steps) < best
            steps = [list(r) for r in model.steps]
            steps[k // 2][k % 2] += by
            assert likelihood(model.weights, steps) < best
