"""What is skipped on a page, and where it ends."""

import pytest

from seriesmith.llm.html_blocks import leaf_blocks

PAGES = [
    ('<p>one<svg class="i"/> two</p><p>three</p>', ["one two", "three"]),
    ("<p>one<svg /> two<svg/> three</p>", ["one two three"]),
    ("<p>a<svg><g><svg><text>x</text></svg><text>y</text></g></svg>b</p><p>c</p>", ["ab", "c"]),
    ("<p>a<svg><svg/><text>x</text></svg>b</p>", ["ab"]),
    ("<div><svg-icon>a</svg-icon><p>b</p></div>", ["a", "b"]),
    ("<template-card><p>a</p></template-card><script-x>b</script-x><iframe-x/>c", ["a", "b", "c"]),
    ("<p>a<svg><path><p>b</p>", ["a", "b"]),
    ("<div>a<svg><path></div><section>b</section>", ["a", "b"]),
    ("<p>a<svg><title>t</title><style>s</style><script/><foreignObject><svg><g/></svg><p>x</p></foreignObject></svg>b</p>", ["ab"]),
    ("<p>a<svg class=i/><text>x</text></svg>b</p>", ["ab"]),
    ("<p>a</p><template><p>x</p><template>y</template>z</template><p>b</p>", ["a", "b"]),
    ('<template><script>"</template>"</script>x</template><p>b</p>', ["b"]),
    ("<p>a<script>x</script >b<SCRIPT>y</scripty></SCRIPT x>c</p><style>z", ["abc"]),
    ("<p>a<noscript>x</noscript>b<iframe src='q'>y</iframe>c</p>", ["abc"]),
]


@pytest.mark.parametrize("page, texts", PAGES)
def test_skipped_elements_take_nothing_else(page, texts):
    assert [b.text for b in leaf_blocks(page)] == texts
