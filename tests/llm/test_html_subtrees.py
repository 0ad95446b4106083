"""Skipped elements without an end tag, and nested ones."""

import pytest

from chronofold.llm.html_tree import SUBTREES, parse


def texts(source):
    return [n.text for n in parse(source) if n.text is not None]


@pytest.mark.parametrize("tag", sorted(SUBTREES))
def test_unclosed_and_nested(tag):
    assert texts(f"<article><p>One.<{tag} x=1><p>Two.</p><p>Three.</article>") == ["One.", "Two.", "Three."]
    assert texts(f"<p>One.</p><{tag}>a<{tag}>b</{tag}>c</{tag}><p>Two.</p>") == ["One.", "Two."]
    assert texts(f"<p>One.</p><{tag}><!-- </{tag}> --><script>'</{tag}>'</script>c</{tag.upper()}><p>Two.</p>") == ["One.", "Two."]
    assert texts(f"<p>One.</p><{tag}><p>Two.</p><{tag}>gone</{tag}><p>Three.</p>") == ["One.", "Two.", "Three."]


def test_raw_text_runs_to_the_end():
    assert texts("<p>One.</p><script>x<p>Two.</p>") == ["One."]
