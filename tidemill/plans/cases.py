"""Made pages, texts and replies of every row of a table, and what is to come of each.

A template stands for a text of each row: @k@ is the row's number, @w@ its word, @p0@ to @p9@ paragraphs that have both.
Both sides of a comparison are made of templates: the input by Spark, the result by SQL. Rows take the variants of a
case in turn by number, so what a rule does and what it leaves alone are held side by side.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARAGRAPH = "Paragraph {} of @w@ @k@ tells a longer story about the harbour, the cranes and the people who mend the nets there."
Texts = dict[str, str | None]


def _pieces(template: str) -> list[str]:
    """Literals, and between them the names of what the row has."""
    return re.split("@([kw])@", re.sub(r"@p(\d+)@", lambda m: _PARAGRAPH.format(m[1]), template))


def filled(template: str | None) -> Column:
    """The template as a column of a frame that has k and w."""
    if template is None:
        return F.lit(None).cast("string")
    return F.concat(*(F.col(p) if n % 2 else F.lit(p) for n, p in enumerate(_pieces(template)) if p)) if template else F.lit("")


def filled_sql(template: str | None) -> str:
    if template is None:
        return "null::varchar"
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    return " || ".join(p if n % 2 else quoted(p) for n, p in enumerate(_pieces(template)) if p or not n)


@dataclass(frozen=True, init=False)
class Case:
    """covers names the operators; variants are pairs of inputs and results."""

    name: str
    kind: str
    covers: str
    variants: tuple[tuple[Texts, Texts], ...]
    options: dict[str, Any] = field(default_factory=dict)

    def __init__(self, name: str, kind: str, covers: str, *variants: tuple[Texts, Texts], options: dict[str, Any] | None = None):
        for key, value in (("name", name), ("kind", kind), ("covers", covers), ("variants", variants), ("options", options or {})):
            object.__setattr__(self, key, value)

    def inputs(self) -> dict[str, Column]:
        """Columns of the inputs, by the row's number."""
        names = dict.fromkeys(k for made, _ in self.variants for k in made)
        of = lambda n, name: filled(self.variants[n][0].get(name))
        out = {}
        for name in names:
            column = of(0, name)
            for n in range(1, len(self.variants)):
                column = F.when(F.col("row") % len(self.variants) == n, of(n, name)).otherwise(column)
            out[name] = column
        return out

    def sql(self) -> str:
        names = dict.fromkeys(k for _, want in self.variants for k in want)
        whens = lambda name: " ".join(f"when {n} then {filled_sql(want.get(name))}" for n, (_, want) in enumerate(self.variants))
        columns = ", ".join(f"case row % {len(self.variants)} {whens(name)} end as {name}" for name in names)
        return f"with b as ({ROWS_SQL}) select row, {columns} from b"


#: Customers, their numbers moved so that all have five digits.
ROWS_SQL = "select c_custkey as row, (c_custkey + 10000)::varchar as k, lower(c_mktsegment) as w from customer"

CASES = (
    Case(
        'ext_driver', 'page', 'EXT-00 EXT-15',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': '<html><head><title>Head @k@</title></head><body><article><h1>Title @k@</h1><p>@p0@</p><p>@p1@</p><p>@p2@</p></article></body></html>'},
            {'markdown': '# Title @k@\n\n\n@p0@\n\n\n@p1@\n\n\n@p2@', 'plain_text': 'Title @k@\n\n\n@p0@\n\n\n@p1@\n\n\n@p2@', 'domain_type': 'article', 'words': '69', 'title': 'Head @k@'},
        ),
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': "<body><div class='docsearch'></div><div id='content'><p>@p0@</p><p>@p1@</p><p>@p2@</p></div></body>"},
            {'markdown': '@p0@\n\n\n@p1@\n\n\n@p2@', 'plain_text': '@p0@\n\n\n@p1@\n\n\n@p2@', 'domain_type': 'documentation', 'words': '66', 'title': None},
        ),
        (
            {'url': 'https://github.com/o@k@/r', 'html': '<body><main><h2>About @w@</h2><p>@p0@</p><p>@p1@</p></main></body>'},
            {'markdown': '## About @w@\n\n\n@p0@\n\n\n@p1@', 'plain_text': 'About @w@\n\n\n@p0@\n\n\n@p1@', 'domain_type': 'git_hub', 'words': '47', 'title': None},
        ),
    ),
    Case(
        'ext_retry_main', 'page', 'EXT-01',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': "<body><article><p>Short @k@ teaser</p></article><div class='content'><p>@p0@</p><p>@p1@</p><p>@p2@</p></div></body>"},
            {'markdown': '@p0@\n\n\n@p1@\n\n\n@p2@', 'words': '66'},
        ),
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': "<body><article><p>@p0@</p><p>@p1@</p></article><div class='content'><p>@p0@</p><p>@p1@</p><p>@p2@</p></div></body>"},
            {'markdown': '@p0@\n\n\n@p1@\n\n\n@p0@\n\n\n@p1@\n\n\n@p2@', 'words': '110'},
        ),
        options={'only_main': True},
    ),
    Case(
        'ext_retry_body', 'page', 'EXT-02',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': '<body><article><p>Only a short teaser of @w@ @k@ stands within the article element here.</p></article><p>@p0@</p><p>@p1@</p><p>@p2@</p><p>@p3@</p></body>'},
            {'markdown': 'Only a short teaser of @w@ @k@ stands within the article element here.\n\n\n@p0@\n\n\n@p1@\n\n\n@p2@\n\n\n@p3@', 'words': '101'},
        ),
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': '<body><article><p>@p0@</p><p>@p1@</p></article><p>One more line about @w@.</p></body>'},
            {'markdown': '@p0@\n\n\n@p1@', 'words': '44'},
        ),
    ),
    Case(
        'ext_only_main', 'page', 'EXT-03',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': "<body><div class='content entry'><p>@p0@</p><p>@p1@</p><p>@p2@</p><p>@p3@</p></div><main><p>@p0@</p><p>@p1@</p><p>@p2@</p><p>@p3@</p><p>@p4@</p><p>@p5@</p><p>@p6@</p><p>@p7@</p><p>@p8@</p><p>@p9@</p></main><article><p>@p0@</p><p>@p1@</p></article></body>"},
            {'markdown': '@p0@\n\n\n@p1@\n\n\n@p2@\n\n\n@p3@\n\n\n@p4@\n\n\n@p5@\n\n\n@p6@\n\n\n@p7@\n\n\n@p8@\n\n\n@p9@'},
        ),
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': "<body><div role='main'><h2>Role @k@</h2><p>@p0@</p><p>@p1@</p></div><article><p>@p0@</p><p>@p1@</p></article></body>"},
            {'markdown': '## Role @k@\n\n\n@p0@\n\n\n@p1@'},
        ),
        options={'only_main': True},
    ),
    Case(
        'ext_include', 'page', 'EXT-04',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': "<body><div class='one'><p>First @k@</p></div><p>Between</p><section id='two'><h3>Second @w@</h3></section></body>"},
            {'markdown': 'First @k@\n\n### Second @w@', 'plain_text': 'First @k@\nSecond @w@'},
        ),
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': "<body><section id='two'><p>Two @k@</p></section><div class='one'>One <b>@w@</b></div><div class='one'>Again</div></body>"},
            {'markdown': 'One **@w@**\n\nAgain\n\nTwo @k@', 'plain_text': 'One @w@\nAgain\nTwo @k@'},
        ),
        options={'include': ('.one', '#two')},
    ),
    Case(
        'ext_exclude', 'page', 'EXT-05',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': "<body><article><p class='gone'>Gone @k@</p><p>@p0@</p><p>@p1@</p><div data-x='1'>Also gone</div><p>Stays @w@</p></article></body>"},
            {'markdown': '@p0@\n\n\n@p1@\n\n\nStays @w@'},
        ),
        options={'exclude': ('.gone', '[data-x]')},
    ),
    Case(
        'ext_candidates', 'page', 'EXT-06 EXT-07',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': "<body><div class='links'><a href='/l0'>A long link label number 0 of @k@</a><a href='/l1'>A long link label number 1 of @k@</a><a href='/l2'>A long link label number 2 of @k@</a><a href='/l3'>A long link label number 3 of @k@</a><a href='/l4'>A long link label number 4 of @k@</a><a href='/l5'>A long link label number 5 of @k@</a></div><div class='post'><p>@p0@</p><p>@p1@</p><p>@p2@</p></div><section><p>@p0@</p></section></body>"},
            {'markdown': '[A long link label number 0 of @k@](https://site@k@.example.com/l0) [A long link label number 1 of @k@](https://site@k@.example.com/l1) [A long link label number 2 of @k@](https://site@k@.example.com/l2) [A long link label number 3 of @k@](https://site@k@.example.com/l3) [A long link label number 4 of @k@](https://site@k@.example.com/l4) [A long link label number 5 of @k@](https://site@k@.example.com/l5)\n\n@p0@\n\n\n@p1@\n\n\n@p2@\n\n\n@p0@'},
        ),
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': "<body><section><p>@p0@</p><p>@p1@</p></section><section id='main-text'><p>@p0@</p><p>@p1@</p><h3>Main @k@</h3></section></body>"},
            {'markdown': '@p0@\n\n\n@p1@\n\n\n### Main @k@'},
        ),
    ),
    Case(
        'ext_h1_recovery', 'page', 'EXT-08',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': "<body><div class='top-bar'><h1>Heading of @w@ @k@!</h1></div><article><p>@p0@</p><p>@p1@</p><p>@p2@</p></article></body>"},
            {'markdown': '# Heading of @w@ @k@\n\n@p0@\n\n\n@p1@\n\n\n@p2@'},
        ),
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': '<body><h1>Plain @k@</h1><article><h2>Plain @k@</h2><p>@p0@</p><p>@p1@</p><p>@p2@</p></article></body>'},
            {'markdown': '## Plain @k@\n\n\n@p0@\n\n\n@p1@\n\n\n@p2@'},
        ),
    ),
    Case(
        'ext_hero', 'page', 'EXT-09',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': "<body><div class='lead'><h1>Lead @k@</h1><p>This is the opening paragraph of @w@, long enough to count.</p></div><article><p>@p0@</p><p>@p1@</p><p>@p2@</p></article></body>"},
            {'markdown': '# Lead @k@\n\nThis is the opening paragraph of @w@, long enough to count.\n\n@p0@\n\n\n@p1@\n\n\n@p2@'},
        ),
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': "<body><div class='lead'><h1>Lead @k@</h1><p>Too short.</p></div><article><p>@p0@</p><p>@p1@</p><p>@p2@</p></article></body>"},
            {'markdown': '# Lead @k@\n\n@p0@\n\n\n@p1@\n\n\n@p2@'},
        ),
    ),
    Case(
        'ext_announcement', 'page', 'EXT-10',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': "<body><div role='region' aria-label='Site Announcement'>Launch of @w@ <a href='/go@k@'>Read it</a></div><article><p>@p0@</p><p>@p1@</p><p>@p2@</p></article></body>"},
            {'markdown': '> **Launch of @w@ Read it**\n\n@p0@\n\n\n@p1@\n\n\n@p2@', 'links': '[{"text":"Read it","href":"https://site@k@.example.com/go@k@"}]'},
        ),
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': "<body><div role='region' aria-label='Weather'>Rain in @w@</div><article><p>@p0@</p><p>@p1@</p><p>@p2@</p></article></body>"},
            {'markdown': '@p0@\n\n\n@p1@\n\n\n@p2@', 'links': '[]'},
        ),
    ),
    Case(
        'ext_section_headings', 'page', 'EXT-11',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': "<body><section><h2>Section of @w@</h2><div class='content post'><p>@p0@</p><p>@p1@</p><p>@p2@</p></div></section></body>"},
            {'markdown': '## Section of @w@\n\n@p0@\n\n\n@p1@\n\n\n@p2@'},
        ),
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': "<body><nav><h2>Menu of @w@</h2></nav><div class='content post'><p>@p0@</p><p>@p1@</p><p>@p2@</p></div></body>"},
            {'markdown': '@p0@\n\n\n@p1@\n\n\n@p2@'},
        ),
    ),
    Case(
        'ext_eyebrow', 'page', 'EXT-11',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': "<body><section><p>Kicker @k@</p><h2>Section of @w@</h2><div class='content post'><p>@p0@</p><p>@p1@</p><p>@p2@</p></div></section></body>"},
            {'markdown': '*Kicker @k@*\n\n## Section of @w@\n\n@p0@\n\n\n@p1@\n\n\n@p2@'},
        ),
    ),
    Case(
        'ext_footer_call', 'page', 'EXT-12',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': "<body><article><p>@p0@</p><p>@p1@</p><p>@p2@</p></article><footer><h2>Start with @w@</h2><a href='https://docs.example.com/@k@'>Documentation @k@</a><a href='/imprint'>Imprint</a></footer></body>"},
            {'markdown': '@p0@\n\n\n@p1@\n\n\n@p2@\n\n## Start with @w@\n\n[Documentation @k@](https://docs.example.com/@k@)\n\n', 'links': '[{"text":"Documentation @k@","href":"https://docs.example.com/@k@"}]'},
        ),
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': "<body><article><p>@p0@</p><p>@p1@</p><p>@p2@</p></article><footer><h2 class='sr-only'>Hidden</h2><h2>Footer</h2><a href='/app/@k@'>Open it</a></footer></body>"},
            {'markdown': '@p0@\n\n\n@p1@\n\n\n@p2@[Open it](https://site@k@.example.com/app/@k@)\n\n', 'links': '[{"text":"Open it","href":"https://site@k@.example.com/app/@k@"}]'},
        ),
    ),
    Case(
        'ext_footer_sitemap', 'page', 'EXT-13',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': "<body><article><p>@p0@</p><p>@p1@</p><p>@p2@</p></article><footer><div><h3>Group 0 @w@</h3><a href='/g0/1'>Entry 0 one</a><a href='/g0/2'>Entry 0 two</a></div><div><h3>Group 1 @w@</h3><a href='/g1/1'>Entry 1 one</a><a href='/g1/2'>Entry 1 two</a></div><div><h3>Group 2 @w@</h3><a href='/g2/1'>Entry 2 one</a><a href='/g2/2'>Entry 2 two</a></div></footer></body>"},
            {'markdown': '@p0@\n\n\n@p1@\n\n\n@p2@\n\n---\n\n**Group 0 @w@**: Entry 0 one, Entry 0 two\n**Group 1 @w@**: Entry 1 one, Entry 1 two\n**Group 2 @w@**: Entry 2 one, Entry 2 two\n', 'links': '[{"text":"Entry 0 one","href":"https://site@k@.example.com/g0/1"},{"text":"Entry 0 two","href":"https://site@k@.example.com/g0/2"},{"text":"Entry 1 one","href":"https://site@k@.example.com/g1/1"},{"text":"Entry 1 two","href":"https://site@k@.example.com/g1/2"},{"text":"Entry 2 one","href":"https://site@k@.example.com/g2/1"},{"text":"Entry 2 two","href":"https://site@k@.example.com/g2/2"}]'},
        ),
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': "<body><article><p>@p0@</p><p>@p1@</p><p>@p2@</p></article><footer><div><h3>Only @k@</h3><a href='/1'>One is</a><a href='/2'>Two is</a></div></footer></body>"},
            {'markdown': '@p0@\n\n\n@p1@\n\n\n@p2@', 'links': '[]'},
        ),
    ),
    Case(
        'ext_image_position', 'page', 'EXT-14',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': "<body><section><h2>Harbour @k@</h2><div class='content post'><p><img src='/i.png' alt='Harbour @k@ from above'></p><p>@p0@</p><p>@p1@</p><p>@p2@</p></div></section></body>"},
            {'markdown': '![Harbour @k@ from above](https://site@k@.example.com/i.png)\n## Harbour @k@\n\n\n\n@p0@\n\n\n@p1@\n\n\n@p2@'},
        ),
    ),
    Case(
        'ext_noise_tags', 'page', 'EXT-16',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': "<body><article><nav>Nav @k@</nav><aside>Aside</aside><script>var x=@k@</script><style>p{}</style><svg><text>x</text></svg><p>@p0@</p><p>@p1@</p><div role='navigation'>Role nav</div><div role='contentinfo'>Role info</div><div role='note'>Kept note @w@</div></article></body>"},
            {'markdown': '@p0@\n\n\n@p1@\n\nKept note @w@'},
        ),
    ),
    Case(
        'ext_noise_forms', 'page', 'EXT-17',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': "<body><article><p>@p0@</p><p>@p1@</p><form><label>Small @k@</label></form><form class='app-form'><p>Long form text of the whole page. Long form text of the whole page. Long form text of the whole page. Long form text of the whole page. Long form text of the whole page. Long form text of the whole page. Long form text of the whole page. Long form text of the whole page. Long form text of the whole page. Long form text of the whole page. Long form text of the whole page. Long form text of the whole page. Long form text of the whole page. Long form text of the whole page. Long form text of the whole page. Long form text of the whole page. Long form text of the whole page. Long form text of the whole page. Long form text of the whole page. Long form text of the whole page. </p></form><form class='newsletter-box'><p>Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. Sign up now. </p></form></article></body>"},
            {'markdown': '@p0@\n\n\n@p1@\n\n\nLong form text of the whole page. Long form text of the whole page. Long form text of the whole page. Long form text of the whole page. Long form text of the whole page. Long form text of the whole page. Long form text of the whole page. Long form text of the whole page. Long form text of the whole page. Long form text of the whole page. Long form text of the whole page. Long form text of the whole page. Long form text of the whole page. Long form text of the whole page. Long form text of the whole page. Long form text of the whole page. Long form text of the whole page. Long form text of the whole page. Long form text of the whole page. Long form text of the whole page.'},
        ),
    ),
    Case(
        'ext_noise_classes', 'page', 'EXT-18',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': "<body><article><div class='sidebar'>Side @k@</div><div class='sidebar-free'>Kept one</div><div id='menu'>Menu</div><div id='menu-container'>Kept two @w@</div><div class='header-top'>Top</div><div class='footer'>Foot</div><p>@p0@</p><p>@p1@</p></article></body>"},
            {'markdown': 'Kept one Kept two @w@\n\n@p0@\n\n\n@p1@'},
        ),
    ),
    Case(
        'ext_noise_consent', 'page', 'EXT-19',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': "<body><article><div id='onetrust-banner'>We use cookies @k@</div><div class='box gdpr-box'>Consent</div><div class='consenting'>Kept @w@</div><p>@p0@</p><p>@p1@</p></article></body>"},
            {'markdown': 'Kept @w@\n\n@p0@\n\n\n@p1@'},
        ),
    ),
    Case(
        'ext_noise_ads', 'page', 'EXT-20',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': "<body><article><div class='ad-slot'>Buy @k@</div><div class='left_ad'>Buy</div><div class='ad'>Buy</div><div class='adage shade'>Kept @w@</div><p>@p0@</p><p>@p1@</p></article></body>"},
            {'markdown': 'Kept @w@\n\n@p0@\n\n\n@p1@'},
        ),
    ),
    Case(
        'ext_noise_descendants', 'page', 'EXT-21',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': '<body><article><p>@p0@</p><p>@p1@</p><aside><div><p>Deep in the aside @k@</p><article><p>@p0@</p></article></div></aside></article></body>'},
            {'markdown': '@p0@\n\n\n@p1@'},
        ),
    ),
    Case(
        'md_headings', 'page', 'MD-00 MD-01',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': '<body><article><h1>One @k@</h1><h2>Two @w@</h2><h3>Three <em>slanted</em></h3><h4>Four</h4><h5>Five</h5><h6>Six @k@</h6><p>@p0@</p><p>@p1@</p></article></body>'},
            {'markdown': '# One @k@\n\n\n## Two @w@\n\n\n### Three *slanted*\n\n\n#### Four\n\n\n##### Five\n\n\n###### Six @k@\n\n\n@p0@\n\n\n@p1@', 'plain_text': 'One @k@\n\n\nTwo @w@\n\n\nThree slanted\n\n\nFour\n\n\nFive\n\n\nSix @k@\n\n\n@p0@\n\n\n@p1@'},
        ),
    ),
    Case(
        'md_links', 'page', 'MD-02',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': "<body><article><p>@p0@</p><p>@p1@</p><p>See <a href='/rel@k@'>relative</a>, <a href='https://o.example.org/@w@'>absolute</a>, <a href='#f'>part</a>, <a href=''>empty</a> and <a>none</a>.</p></article></body>"},
            {'markdown': '@p0@\n\n\n@p1@\n\n\nSee [relative](https://site@k@.example.com/rel@k@), [absolute](https://o.example.org/@w@), [part](https://site@k@.example.com/a/b#f), [empty](https://site@k@.example.com/a/b) and none.', 'links': '[{"text":"relative","href":"https://site@k@.example.com/rel@k@"},{"text":"absolute","href":"https://o.example.org/@w@"},{"text":"part","href":"https://site@k@.example.com/a/b#f"},{"text":"empty","href":"https://site@k@.example.com/a/b"}]', 'plain_text': '@p0@\n\n\n@p1@\n\n\nSee relative, absolute, part, empty and none.'},
        ),
    ),
    Case(
        'md_images', 'page', 'MD-03',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': "<body><article><p>@p0@</p><p>@p1@</p><p><img src='/i@k@.png' alt='Alt @w@'><img data-src='lazy.png' alt='Lazy'><img src='data:image/png;base64,x' srcset='/s1.png 100w, /s2.png 300w' alt='Set'><img alt='none'></p></article></body>"},
            {'markdown': '@p0@\n\n\n@p1@\n\n\n![Alt @w@](https://site@k@.example.com/i@k@.png)![Lazy](https://site@k@.example.com/a/lazy.png)![Set](https://site@k@.example.com/s2.png)![none](https://site@k@.example.com/a/b)', 'images': '[{"alt":"Alt @w@","src":"https://site@k@.example.com/i@k@.png"},{"alt":"Lazy","src":"https://site@k@.example.com/a/lazy.png"},{"alt":"Set","src":"https://site@k@.example.com/s2.png"},{"alt":"none","src":"https://site@k@.example.com/a/b"}]'},
        ),
    ),
    Case(
        'md_emphasis', 'page', 'MD-04',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': '<body><article><p>@p0@</p><p>@p1@</p><p><strong>Strong @k@</strong> and <b>bold</b>, <em>em @w@</em> and <i>it</i>.</p><b><p>Block in bold</p></b></article></body>'},
            {'markdown': '@p0@\n\n\n@p1@\n\n\n**Strong @k@** and **bold**, *em @w@* and *it*.\n\n\nBlock in bold', 'plain_text': '@p0@\n\n\n@p1@\n\n\nStrong @k@ and bold, em @w@ and it.\n\n\nBlock in bold'},
        ),
    ),
    Case(
        'md_code', 'page', 'MD-05',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': "<body><article><p>@p0@</p><p>@p1@</p><p>Call <code>run_@k@()</code> now.</p><pre><code class='language-js'>let a = @k@;\n  b();</code></pre><pre class='highlight-py'>x = '@w@'</pre><pre>plain<br>two</pre></article></body>"},
            {'markdown': "@p0@\n\n\n@p1@\n\n\nCall `run_@k@()` now.\n\n\n```js\nlet a = @k@;\n  b();\n```\n\n\n```python\nx = '@w@'\n```\n\n\n```\nplain\ntwo\n```", 'code_blocks': '[{"language":"js","code":"let a = @k@;\\n  b();"},{"language":"python","code":"x = \'@w@\'"},{"code":"plain\\ntwo"}]'},
        ),
    ),
    Case(
        'md_quotes_rules', 'page', 'MD-06',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': '<body><article><p>@p0@</p><p>@p1@</p><blockquote><p>Quoted @k@</p><p>Again @w@</p></blockquote><hr><p>Line one<br>line two @k@</p></article></body>'},
            {'markdown': '@p0@\n\n\n@p1@\n\n\n> Quoted @k@\n>\n>\n>\n> Again @w@\n\n\n---\n\n\nLine one line two @k@'},
        ),
    ),
    Case(
        'md_lists', 'page', 'MD-07',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': '<body><article><p>@p0@</p><p>@p1@</p><ul><li>One @k@<ul><li>Inner <b>@w@</b></li><li>Other</li></ul></li><li>Two</li></ul><ol><li>First</li><li>Second @k@</li></ol></article></body>'},
            {'markdown': '@p0@\n\n\n@p1@\n\n\n- One @k@\n  - Inner **@w@**\n  - Other- Two\n\n\n1. First\n2. Second @k@', 'plain_text': '@p0@\n\n\n@p1@\n\n\n- One @k@\n  - Inner @w@\n  - Other- Two\n\n\n1. First\n2. Second @k@'},
        ),
    ),
    Case(
        'md_tables', 'page', 'MD-08',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': '<body><article><p>@p0@</p><p>@p1@</p><table><tr><th>Name</th><th>Value</th></tr><tr><td>@w@</td><td>@k@</td></tr><tr><td>short</td></tr></table><table><tr><td><p>Layout @k@</p></td><td>Cell @w@</td></tr></table></article></body>'},
            {'markdown': '@p0@\n\n\n@p1@\n\n\n| Name | Value |\n| --- | --- |\n| @w@ | @k@ |\n| short |  |\n\n\nLayout @k@\n\nCell @w@', 'plain_text': '@p0@\n\n\n@p1@\n\n\nName\tValue\n@w@\t@k@\nshort\n\n\nLayout @k@\n\nCell @w@'},
        ),
    ),
    Case(
        'md_spacing', 'page', 'MD-09',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': "<body><article><p>@p0@</p><p>@p1@</p><p><b>Bold@k@</b><i>italic</i>, <a href='/x'>link</a>text <code>fn</code>s and <code>Cls</code>'s (<b>@w@</b>)</p></article></body>"},
            {'markdown': "@p0@\n\n\n@p1@\n\n\n**Bold@k@** *italic*, [link](https://site@k@.example.com/x) text `fn`s and `Cls`'s (**@w@**)"},
        ),
    ),
    Case(
        'md_noise_assets', 'page', 'MD-10',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': "<body><article><p>@p0@</p><p>@p1@</p><aside><a href='/rel'>Relative in aside</a><a href='https://x.example.org/@k@'>Far @w@</a><img src='/logo.png' alt='Logo @k@'><img src='/nolabel.png'></aside></article></body>"},
            {'links': '[{"text":"Relative in aside","href":"https://site@k@.example.com/rel"},{"text":"Far @w@","href":"https://x.example.org/@k@"}]', 'images': '[{"alt":"Logo @k@","src":"https://site@k@.example.com/logo.png"}]', 'markdown': '@p0@\n\n\n@p1@'},
        ),
    ),
    Case(
        'md_resolution', 'page', 'MD-11',
        (
            {'url': 'https://site@k@.example.com/dir/page?q=1', 'html': "<body><article><p>@p0@</p><p>@p1@</p><p><a href='up'>a one</a> <a href='../x/./y'>b two</a> <a href='//cdn.example.org/z'>c three</a> <a href='?r=@w@'>d four</a> <a href='/root#f'>e five</a> <a href='mailto:a.b'>f six</a></p></article></body>"},
            {'links': '[{"text":"a one","href":"https://site@k@.example.com/dir/up"},{"text":"b two","href":"https://site@k@.example.com/x/y"},{"text":"c three","href":"//cdn.example.org/z"},{"text":"d four","href":"https://site@k@.example.com/dir/page?r=@w@"},{"text":"e five","href":"https://site@k@.example.com/root#f"},{"text":"f six","href":"mailto:a.b"}]'},
        ),
    ),
    Case(
        'md_whitespace', 'page', 'MD-12',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': '<body><article><p>@p0@</p><p>  Many   spaces\n and\tbreaks @k@  </p>\n\n\n<div>\n\n\n</div><p></p><p></p><p>After @w@</p><p>@p0@</p><pre>a\n\n\n\nb</pre></article></body>'},
            {'markdown': '@p0@\n\n\nMany spaces and breaks @k@\n\n\nAfter @w@\n\n\n@p0@\n\n\n```\na\n\n\n\nb\n```'},
        ),
    ),
    Case(
        'md_plain', 'page', 'MD-13',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': "<body><article><h2>Head @k@</h2><p>@p0@</p><p>@p1@</p><p><b>bold</b> <i>it</i> <code>co</code> <a href='/l'>link @w@</a> <img src='/i.png' alt='pic'></p><pre><code>x @k@</code></pre><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table></article></body>"},
            {'plain_text': 'Head @k@\n\n\n@p0@\n\n\n@p1@\n\n\nbold it co link @w@ pic\n\n\n``\nx @k@\n``\n\n\na\tb\n1\t2'},
        ),
    ),
    Case(
        'meta_fields', 'page', 'META-01',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': "<html lang='de'><head><title> Title @k@ </title><meta property='og:title' content='OG @k@'><meta name='description' content='D @w@'><meta property='og:description' content='OD @w@'><meta name='author' content='A @w@'><meta property='article:published_time' content='2020-01-02'><meta property='og:site_name' content='S @k@'><meta property='og:image' content='/i@k@.png'><link rel='shortcut icon' href='/f.ico'></head><body><article><p>@p0@</p><p>@p1@</p></article></body></html>"},
            {'metadata': '{"title":"OG @k@","description":"OD @w@","author":"A @w@","published_date":"2020-01-02","language":"de","url":"https://site@k@.example.com/a/b","site_name":"S @k@","image":"/i@k@.png","favicon":"/f.ico","word_count":44}'},
        ),
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': "<html><head><title>Only @k@</title><meta name='twitter:description' content='T @w@'><meta name='date' content='2021'><meta property='article:author' content='B'><meta name='twitter:image' content='t.png'></head><body><article><p>@p0@</p><p>@p1@</p></article></body></html>"},
            {'metadata': '{"title":"Only @k@","description":"T @w@","author":"B","published_date":"2021","url":"https://site@k@.example.com/a/b","image":"t.png","word_count":44}'},
        ),
    ),
    Case(
        'json_ld', 'page', 'JSON-01 SET-04',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': '<body><script type=\'application/ld+json\'>{"@type":"Article","headline":"H @k@"}</script><script type="APPLICATION/LD+JSON">[{"a":1},{"b":"@w@"}]</script><script type=\'application/ld+json\'>{broken</script><article><h1>Title @k@</h1><p>@p0@</p><p>@p1@</p><p>@p2@</p></article></body>'},
            {'structured_data': '["{\\"@type\\":\\"Article\\",\\"headline\\":\\"H @k@\\"}","{\\"a\\":1}","{\\"b\\":\\"@w@\\"}"]'},
        ),
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': '<body><script type=\'application/ld+json\'>{"text":"two\nlines @k@"}</script><article><h1>Title @k@</h1><p>@p0@</p><p>@p1@</p><p>@p2@</p></article></body>'},
            {'structured_data': '["{\\"text\\":\\"two\\\\nlines @k@\\"}"]'},
        ),
    ),
    Case(
        'json_next', 'page', 'JSON-02',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': '<body><script id=\'__NEXT_DATA__\' type=\'application/json\'>{"props":{"pageProps":{"item":{"id":@k@,"name":"@w@"}}},"page":"/"}</script><article><h1>Title @k@</h1><p>@p0@</p><p>@p1@</p><p>@p2@</p></article></body>'},
            {'structured_data': '["{\\"item\\":{\\"id\\":@k@,\\"name\\":\\"@w@\\"}}"]'},
        ),
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': '<body><script id=\'__NEXT_DATA__\' type=\'application/json\'>{"props":{"pageProps":{}},"page":"/p@k@"}</script><article><h1>Title @k@</h1><p>@p0@</p><p>@p1@</p><p>@p2@</p></article></body>'},
            {'structured_data': '["{\\"page\\":\\"/p@k@\\",\\"props\\":{\\"pageProps\\":{}}}"]'},
        ),
    ),
    Case(
        'json_svelte', 'page', 'JSON-03',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': '<body><article><h1>Title @k@</h1><p>@p0@</p><p>@p1@</p><p>@p2@</p></article><script>kit.start(app, element, {node_ids: [0, 2], data: [{type:"data",data:{title:"Svelte @w@",number:@k@,list:[1,2,3]},uses:{}},null]});</script></body>'},
            {'structured_data': '["{\\"list\\":[1,2,3],\\"number\\":@k@,\\"title\\":\\"Svelte @w@\\"}"]'},
        ),
    ),
    Case(
        'json_islands', 'page', 'JSON-04',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': '<body><article><p>Only a few words of @w@ here.</p></article><script type=\'application/json\'>{"section":{"heading":"A heading about @w@ today","description":"The body text of number @k@ says a little more."},"q":{"quote":"What people say about harbour @k@","author":"Ann"}}</script></body>'},
            {'markdown': 'Only a few words of @w@ here.\n\n> What people say about harbour @k@\n> — Ann\n\n\n## A heading about @w@ today\n\nThe body text of number @k@ says a little more.'},
        ),
    ),
    Case(
        'json_scripts', 'page', 'JSON-05 JSON-06',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': '<body><article><p>Only a few words of @w@ here.</p></article><script>window.__STATE__ = {"a":{"text":"Readable Sentence about number @k@ of the state.","u":"https://x.example.com/not/text"},"css":"a{b:c} is not read here","more":"Another Sentence of @w@ that is long enough"};</script></body>'},
            {'markdown': 'Only a few words of @w@ here.\n\n## Additional Content\n\nReadable Sentence about number @k@ of the state.\n\nAnother Sentence of @w@ that is long enough'},
        ),
    ),
    Case(
        'json_fragments', 'page', 'JSON-06',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': '<body><article><p>Only a few words of @w@ here.</p></article><script>self.__next_f.push([1,"1|{\\"t\\":\\"Pushed Sentence number @k@ of the page.\\"}\\n"])</script><script>self.__next_f.push([1,"2|[\\"Another Pushed Sentence about @w@ here\\"]\\n"])</script></body>'},
            {'markdown': 'Only a few words of @w@ here.\n\n## Additional Content\n\nPushed Sentence number @k@ of the page.\n\nAnother Pushed Sentence about @w@ here'},
        ),
    ),
    Case(
        'site_video', 'page', 'SITE-01',
        (
            {'url': 'https://www.youtube.com/watch?v=v@k@', 'html': '<html><head><title>T</title></head><body><script>var ytInitialPlayerResponse = {"videoDetails":{"title":"Video @k@","author":"Ch @w@","viewCount":"12345","lengthSeconds":"3725","shortDescription":"About @w@"},"microformat":{"playerMicroformatRenderer":{"uploadDate":"2020-05-06"}},"captions":{"playerCaptionsTracklistRenderer":{"captionTracks":[{"baseUrl":"https://c.example.com/@k@","languageCode":"en","name":{"simpleText":"English"}}]}}};</script></body></html>'},
            {'markdown': '# Video @k@\n\n**Channel:** Ch @w@ | **Views:** 12.3K | **Published:** 2020-05-06 | **Duration:** 1:02:05\n\n## Description\n\nAbout @w@\n', 'plain_text': 'About @w@', 'domain_type': 'social'},
        ),
        (
            {'url': 'https://youtu.be/v@k@', 'html': '<body><article><h1>Title @k@</h1><p>@p0@</p><p>@p1@</p><p>@p2@</p></article></body>'},
            {'markdown': '# Title @k@\n\n\n@p0@\n\n\n@p1@\n\n\n@p2@', 'plain_text': 'Title @k@\n\n\n@p0@\n\n\n@p1@\n\n\n@p2@', 'domain_type': 'article'},
        ),
    ),
    Case(
        'site_thread', 'page', 'SITE-03',
        (
            {'url': 'https://old.reddit.com/r/harbour/comments/p@k@/x/', 'html': "<html><body><div id='siteTable'><div class='thing link self' data-fullname='t3_p@k@' data-author='op@w@' data-subreddit='harbour' data-score='@k@' data-comments-count='2' data-permalink='/r/harbour/comments/p@k@/x/'><div class='entry'><p class='title'><a class='title' href='/x'>Post @k@</a></p><div class='expando'><form class='usertext'><div class='usertext-body'><div class='md'><p>Body of <strong>@w@</strong></p></div></div></form></div></div></div></div><div class='commentarea'><div class='sitetable nestedlisting'><div class='thing comment ' data-fullname='t1_a' data-author='ann'><div class='entry'><span class='score unvoted' title='5'>5 points</span><form class='usertext'><div class='usertext-body'><div class='md'><p>First @k@</p></div></div></form></div><div class='child'><div class='sitetable listing'><div class='thing comment ' data-fullname='t1_b' data-author='op@w@'><div class='entry'><span class='score unvoted' title='5'>5 points</span><form class='usertext'><div class='usertext-body'><div class='md'><p>Reply <em>@w@</em></p><blockquote><p>q</p></blockquote></div></div></form></div><div class='child'><div class='sitetable listing'></div></div></div></div></div></div><div class='thing comment deleted' data-fullname='t1_c' data-author=''><div class='entry'><span class='score unvoted' title='5'>5 points</span><form class='usertext'><div class='usertext-body'><div class='md'></div></div></form></div><div class='child'><div class='sitetable listing'></div></div></div></div></div></body></html>"},
            {'markdown': '# Post @k@\n\n**u/op@w@** · r/harbour · @k@ pts · 2 comments\n\nBody of **@w@**\n\n---\n\n## Comments\n\n**u/ann** · 5 pts\nFirst @k@\n\n> **u/op@w@ [OP]** · 5 pts\n> Reply *@w@*\n>\n> > q\n\n**u/[deleted]** · 5 pts\n[removed]', 'plain_text': 'Post @k@\n\nu/op@w@ · r/harbour · @k@ pts · 2 comments\n\nBody of @w@\n\n---\n\nComments\n\nu/ann · 5 pts\nFirst @k@\n\nu/op@w@ [OP] · 5 pts\nReply @w@\n\n> q\n\nu/[deleted] · 5 pts\n[removed]', 'metadata': '{"title":"Post @k@","author":"op@w@","language":"en","url":"https://old.reddit.com/r/harbour/comments/p@k@/x/","site_name":"harbour","word_count":42}'},
        ),
    ),
    Case(
        'site_post', 'page', 'SITE-04 JOIN-09',
        (
            {'url': 'https://www.linkedin.com/posts/ann_@k@', 'html': '<html><body><code>{&quot;included&quot;:[{&quot;$type&quot;:&quot;com.x.Profile&quot;,&quot;entityUrn&quot;:&quot;urn:p@k@&quot;,&quot;firstName&quot;:&quot;Ann&quot;,&quot;lastName&quot;:&quot;@w@&quot;,&quot;headline&quot;:&quot;Mends nets&quot;},{&quot;$type&quot;:&quot;com.x.Update&quot;,&quot;actor&quot;:{&quot;*author&quot;:&quot;urn:p@k@&quot;},&quot;commentary&quot;:{&quot;text&quot;:{&quot;text&quot;:&quot;Post text @k@&quot;}}},{&quot;$type&quot;:&quot;com.x.Comment&quot;,&quot;commenter&quot;:{&quot;title&quot;:{&quot;text&quot;:&quot;Bob&quot;}},&quot;commentary&quot;:{&quot;text&quot;:&quot;Fine @w@&quot;}}],&quot;pad&quot;:&quot;xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx&quot;}</code></body></html>'},
            {'markdown': '# Ann @w@\n\n*Mends nets*\n\n---\n\nPost text @k@\n\n---\n\n## Comments\n\n- **Bob**: Fine @w@\n\n', 'metadata': '{"title":"Ann @w@\'s LinkedIn Post","author":"Ann @w@","url":"https://www.linkedin.com/posts/ann_@k@","site_name":"LinkedIn","word_count":16}'},
        ),
    ),
    Case(
        'llm_entities', 'body', 'LLM-01',
        (
            {'text': 'A &amp; B &lt;@k@&gt; &#8364; &#x41; &unknown; &copy; @w@ ends here.\n\n```\nx = 1\n```'},
            {'llm_text': 'A & B <@k@> € A &unknown; © @w@ ends here.\n\n```\nx = 1\n```', 'links': '[]'},
        ),
        (
            {'text': 'Double &amp;amp; of @w@ @k@ once.'},
            {'llm_text': 'Double &amp; of @w@ @k@ once.', 'links': '[]'},
        ),
    ),
    Case(
        'llm_invisible', 'body', 'LLM-02',
        (
            {'text': 'Soft\xadhyphen zero\u200bwidth @k@ \ufeffmark of @w@ in a line.'},
            {'llm_text': 'Softhyphen zerowidth @k@ mark of @w@ in a line.', 'links': '[]'},
        ),
    ),
    Case(
        'llm_leaked_scripts', 'body', 'LLM-03',
        (
            {'text': 'This sentence of @w@ number @k@ stays as it is in the text. self.__next_f.push([1,2])\n\nOther line of @k@ with self. only in it.\n\n```\nself.__x\n```'},
            {'llm_text': 'This sentence of @w@ number @k@ stays as it is in the text.\n\nOther line of @k@ with self. only in it.\n\n```\nself.__x\n```', 'links': '[]'},
        ),
    ),
    Case(
        'llm_link_chrome', 'body', 'LLM-04',
        (
            {'text': 'Read the guide of @w@, opens in a new tab and go.\n\nSee the other @k@ text (opens new window) here.\n\nAn external link here of @k@.'},
            {'llm_text': 'Read the guide of @w@ and go.\n\nSee the other @k@ text here.\n\nAn external link here of @k@.', 'links': '[]'},
        ),
    ),
    Case(
        'llm_spaced', 'body', 'LLM-05',
        (
            {'text': 'H A R B O U R\n\nN e w T o w n\n\nThe town of @w@ number @k@ is the place of a fresh S t a r t\n\na b c is short for @w@ here.'},
            {'llm_text': 'HARBOUR New Town\n\nThe town of @w@ number @k@ is the place of a fresh Start\n\na b c is short for @w@ here.', 'links': '[]'},
        ),
    ),
    Case(
        'llm_linked_images', 'body', 'LLM-06',
        (
            {'text': 'This sentence of @w@ number @k@ stays as it is in the text.\n\n[![Shot of the harbour](/i.png)](https://x.example.com/@k@) is linked here.'},
            {'llm_text': 'This sentence of @w@ number @k@ stays as it is in the text.\n\nShot of the harbour\nis linked here.', 'links': '[{"text":"Shot of the harbour","href":"https://x.example.com/@k@"}]'},
        ),
    ),
    Case(
        'llm_logo_rows', 'body', 'LLM-07',
        (
            {'text': 'This sentence of @w@ number @k@ stays as it is in the text.\n\n![Acme](/a.png)\n![Bolt](/b.png)\n\n![Cord @w@](/c.png)\n\nText after @k@ goes on here as before.'},
            {'llm_text': 'This sentence of @w@ number @k@ stays as it is in the text.\n\nAcme, Bolt, Cord @w@\nText after @k@ goes on here as before.', 'links': '[]'},
        ),
        (
            {'text': 'This sentence of @w@ number @k@ stays as it is in the text.\n\n![Single](/a.png)\n\nText after @k@ goes on here as before.'},
            {'llm_text': 'This sentence of @w@ number @k@ stays as it is in the text.\n\nText after @k@ goes on here as before.', 'links': '[]'},
        ),
        (
            {'text': 'This sentence of @w@ number @k@ stays as it is in the text.\n\n![A single image with a long description of @w@](/a.png)\n\nText after @k@ goes on here.'},
            {'llm_text': 'This sentence of @w@ number @k@ stays as it is in the text.\n\nA single image with a long description of @w@\nText after @k@ goes on here.', 'links': '[]'},
        ),
    ),
    Case(
        'llm_images', 'body', 'LLM-08',
        (
            {'text': 'This sentence of @w@ number @k@ stays as it is in the text. ![short](/a.png) inline stays @k@.\n\nText with ![one @w@](/1.png) and ![a much longer description of the second image](/2.png) there.'},
            {'llm_text': 'This sentence of @w@ number @k@ stays as it is in the text. inline stays @k@.\n\nText with and there.\none @w@\na much longer description of the second image', 'links': '[]'},
        ),
    ),
    Case(
        'llm_image_names', 'body', 'LLM-09',
        (
            {'text': 'This sentence of @w@ number @k@ stays as it is in the text.\n\nphoto-@k@.JPG\n\nhero.webp\n\nsee photo.jpg of @w@ for more words.\n\n- item.png'},
            {'llm_text': 'This sentence of @w@ number @k@ stays as it is in the text.\n\nsee photo.jpg of @w@ for more words.\n\n- item.png', 'links': '[]'},
        ),
    ),
    Case(
        'llm_emphasis', 'body', 'LLM-10',
        (
            {'text': 'Some **bold @k@** and *italic @w@* and __strong__ and _under_ but snake_case_name stays.\n\n```\n**kept**\n```'},
            {'llm_text': 'Some bold @k@ and italic @w@ and strong and under but snake_case_name stays.\n\n```\n**kept**\n```', 'links': '[]'},
        ),
    ),
    Case(
        'llm_descriptions', 'body', 'LLM-11 AGG-07',
        (
            {'text': 'This sentence of @w@ number @k@ stays as it is in the text.\n\nImage of a harbour number @k@ at night.\n\na.png) b.jpg)\n\nAcme Shop, Acme Tools, Acme Home, Acme Cars, Bolt Now\n\n- Image of a kept list item @w@ here.'},
            {'llm_text': 'This sentence of @w@ number @k@ stays as it is in the text.\n\n- Image of a kept list item @w@ here.', 'links': '[]'},
        ),
    ),
    Case(
        'llm_controls', 'body', 'LLM-12',
        (
            {'text': 'This sentence of @w@ number @k@ stays as it is in the text.\n\nclose\n\nprev 2 next\n\nmenu of the house @k@ is served daily at noon.\n\nYour browser does not support the video tag of @w@.'},
            {'llm_text': 'This sentence of @w@ number @k@ stays as it is in the text.\n\nmenu of the house @k@ is served daily at noon.', 'links': '[]'},
        ),
    ),
    Case(
        'llm_long_alts', 'body', 'LLM-13',
        (
            {'text': 'This sentence of @w@ number @k@ stays as it is in the text.\n\nAn illustration of a very long scene with the @w@ harbour and cranes and people number @k@ standing.\n\nThis element contains one thing. And two things of @k@. Rest of the @w@ text stays'},
            {'llm_text': 'This sentence of @w@ number @k@ stays as it is in the text.', 'links': '[]'},
        ),
    ),
    Case(
        'llm_styles', 'body', 'LLM-14',
        (
            {'text': 'This sentence of @w@ number @k@ stays as it is in the text.\n\n.a{color:red;margin:0}\n\n@media (max-width:1px){.b{x:y} Text after rules of @k@ stays here.\n\nA sentence: with {braces} of @w@ stays.'},
            {'llm_text': 'This sentence of @w@ number @k@ stays as it is in the text.\n\nText after rules of @k@ stays here.\n\nA sentence: with {braces} of @w@ stays.', 'links': '[]'},
        ),
    ),
    Case(
        'llm_word_lists', 'body', 'LLM-15',
        (
            {'text': 'This sentence of @w@ number @k@ stays as it is in the text.\n\nStart @k@ Name0 Town0 Name1 Town1 Name2 Town2 Name3 Town3 Name4 Town4 Name5 Town5 Name6 Town6 Name7 Town7 Name8 Town8 Name9 Town9 Name10 Town10 Name11 Town11 Name12 Town12 Name13 Town13 Name14 Town14 Name15 Town15 Name16 Town16 Name17 Town17 Name18 Town18 Name19 Town19 End'},
            {'llm_text': 'This sentence of @w@ number @k@ stays as it is in the text.\n\nStart @k@ Name0 ... and 40 more', 'links': '[]'},
        ),
        (
            {'text': 'The list of @k@ is as it was in the year that we had it for you. Name0 Town0 Name1 Town1 Name2 Town2 Name3 Town3 Name4 Town4 Name5 Town5 Name6 Town6 Name7 Town7 Name8 Town8 Name9 Town9 Name10 Town10 Name11 Town11 Name12 Town12 Name13 Town13 Name14 Town14 Name15 Town15 Name16 Town16 Name17 Town17 Name18 Town18 Name19 Town19 Name0 Town0 Name1 Town1 Name2 Town2 Name3 Town3 Name4 Town4 Name5 Town5 Name6 Town6 Name7 Town7 Name8 Town8 Name9 Town9 Name10 Town10 Name11 Town11 Name12 Town12 Name13 Town13 Name14 Town14 Name15 Town15 Name16 Town16 Name17 Town17 Name18 Town18 Name19 Town19'},
            {'llm_text': 'The list of @k@ is as it was in the year that we had it for', 'links': '[]'},
        ),
    ),
    Case(
        'llm_learn_more', 'body', 'LLM-16',
        (
            {'text': 'Our pricing for the @w@ harbour @k@ is simple.\nLearn more pricing for the @w@ harbour\nNext line of the text @k@ goes on.\n\nLearn more'},
            {'llm_text': 'Our pricing for the @w@ harbour @k@ is simple.\nNext line of the text @k@ goes on.\n\nLearn more', 'links': '[]'},
        ),
    ),
    Case(
        'llm_links', 'body', 'LLM-17 SET-03 FLT-13',
        (
            {'text': 'Go to [the harbour](https://h.example.com/@k@) or [again](https://h.example.com/@k@) and [top](#top), [reply](/r), [5 days ago](/d), [other @w@](/o).'},
            {'llm_text': 'Go to the harbour or again and top, reply, 5 days ago, other @w@.', 'links': '[{"text":"the harbour","href":"https://h.example.com/@k@"},{"text":"other @w@","href":"/o"}]'},
        ),
    ),
    Case(
        'llm_numbers', 'body', 'LLM-18',
        (
            {'text': 'This sentence of @w@ number @k@ stays as it is in the text.\n\n42\n\nText between @k@ and more of it.\n12\nwith a number in a block.'},
            {'llm_text': 'This sentence of @w@ number @k@ stays as it is in the text.\n\nText between @k@ and more of it.\n12\nwith a number in a block.', 'links': '[]'},
        ),
    ),
    Case(
        'llm_repeats', 'body', 'LLM-19',
        (
            {'text': 'the @w@ harbour the @w@ harbour opens at nine on day @k@ of the year.\n\nBuy it now buy it now Buy it now Buy it now for @k@ coins.'},
            {'llm_text': 'the @w@ harbour opens at nine on day @k@ of the year.\n\nBuy it now buy it now Buy it now for @k@ coins.', 'links': '[]'},
        ),
    ),
    Case(
        'llm_heading_paragraph', 'body', 'LLM-20',
        (
            {'text': '## Harbour of @w@\n\nHarbour of @w@ opens daily\n\n## Longer heading of @k@ than text\n\nLonger heading of @k@\n\nThis sentence of @w@ number @k@ stays as it is in the text.'},
            {'llm_text': '## Longer heading of @k@ than text\n\nThis sentence of @w@ number @k@ stays as it is in the text.', 'links': '[]'},
        ),
    ),
    Case(
        'llm_heading_texts', 'body', 'LLM-21',
        (
            {'text': '## Prices @k@\n\nThis sentence of @w@ number @k@ stays as it is in the text.\n\nPrices @k@\n\nOther line with Prices @k@ in it.'},
            {'llm_text': '## Prices @k@\n\nThis sentence of @w@ number @k@ stays as it is in the text.\n\nOther line with Prices @k@ in it.', 'links': '[]'},
        ),
    ),
    Case(
        'llm_repeated_headings', 'body', 'LLM-22',
        (
            {'text': '## About @w@\n\nFirst text of the section, which is long enough.\n\n## Other @k@\n\nThis sentence of @w@ number @k@ stays as it is in the text.\n\n## About @w@\n\nFirst text of the section, which is long enough.\nA new line below that stays in.'},
            {'llm_text': '## About @w@\n\nFirst text of the section, which is long enough.\n\n## Other @k@\n\nThis sentence of @w@ number @k@ stays as it is in the text.\n\nA new line below that stays in.', 'links': '[]'},
        ),
    ),
    Case(
        'llm_empty_headings', 'body', 'LLM-23',
        (
            {'text': '## ***\n\nThis sentence of @w@ number @k@ stays as it is in the text.\n\n## Navigation\n\n### Kept @k@\n\nText of the kept heading goes here @w@.'},
            {'llm_text': 'This sentence of @w@ number @k@ stays as it is in the text.\n\n### Kept @k@\n\nText of the kept heading goes here @w@.', 'links': '[]'},
        ),
    ),
    Case(
        'llm_asset_labels', 'body', 'LLM-24',
        (
            {'text': 'This sentence of @w@ number @k@ stays as it is in the text.\n\nHome | Card | Cover\n\nhero-image-@k@-large\n\nteam > cover image\n\nGrowth 50% | Users | Rate\n\nA normal line of @w@ stays in the text.'},
            {'llm_text': 'This sentence of @w@ number @k@ stays as it is in the text.\n\nGrowth 50% | Users | Rate A normal line of @w@ stays in the text.', 'links': '[]'},
        ),
    ),
    Case(
        'llm_style_words', 'body', 'LLM-25 EXT-23',
        (
            {'text': 'This sentence of @w@ number @k@ stays as it is in the text.\n\nflex items-center mt-4 px-2 hidden\n\n-\n\nReal words of @k@ end here flex mt-4\n\n- flex list item of @w@ stays'},
            {'llm_text': 'This sentence of @w@ number @k@ stays as it is in the text.\n\nReal words of @k@ end here\n\n- flex list item of @w@ stays', 'links': '[]'},
        ),
    ),
    Case(
        'llm_whitespace', 'body', 'LLM-26',
        (
            {'text': '\n\nThis sentence of @w@ number @k@ stays as it is in the text.   \n\n\n\n\nSecond line of @k@ in the text.\t\n\n\n'},
            {'llm_text': 'This sentence of @w@ number @k@ stays as it is in the text.\n\nSecond line of @k@ in the text.', 'links': '[]'},
        ),
    ),
    Case(
        'llm_block_dedup', 'body', 'LLM-27',
        (
            {'text': 'This sentence of @w@ number @k@ stays as it is in the text.\n\nA block of some length about @k@ that comes twice.\n\nBetween the two there is another block of @w@.\n\nA block of some length, about @k@: that comes TWICE.'},
            {'llm_text': 'This sentence of @w@ number @k@ stays as it is in the text.\n\nA block of some length about @k@ that comes twice.\n\nBetween the two there is another block of @w@.', 'links': '[]'},
        ),
    ),
    Case(
        'llm_line_dedup', 'body', 'LLM-28',
        (
            {'text': 'A first line of the block number @k@ here.\nAnother line of the same block of @w@.\nA first line of the block number @k@ here.\nshort\nshort'},
            {'llm_text': 'A first line of the block number @k@ here.\nAnother line of the same block of @w@.\nshort\nshort', 'links': '[]'},
        ),
    ),
    Case(
        'llm_comma_lists', 'body', 'LLM-29',
        (
            {'text': 'This sentence of @w@ number @k@ stays as it is in the text.\n\na@k@, b, c, a@k@, b, c\n\none, ONE, two @w@, three and more of it'},
            {'llm_text': 'This sentence of @w@ number @k@ stays as it is in the text.\n\na@k@, b, c one, two @w@, three and more of it', 'links': '[]'},
        ),
    ),
    Case(
        'llm_trailing_headings', 'body', 'LLM-30',
        (
            {'text': '## First @k@\n\nThis sentence of @w@ number @k@ stays as it is in the text.\n\n## Second of @w@\n\n## Third\n\n### Deep'},
            {'llm_text': '## First @k@\n\nThis sentence of @w@ number @k@ stays as it is in the text.\n\n## Third', 'links': '[]'},
        ),
    ),
    Case(
        'llm_empty_code', 'body', 'LLM-31',
        (
            {'text': 'This sentence of @w@ number @k@ stays as it is in the text.\n\n```\n\n```\n\n```python\nx = @k@\n```\n\nAfter the code of @w@ more text.'},
            {'llm_text': 'This sentence of @w@ number @k@ stays as it is in the text.\n\n```python\nx = @k@\n```\n\nAfter the code of @w@ more text.', 'links': '[]'},
        ),
    ),
    Case(
        'llm_statistics', 'body', 'LLM-32',
        (
            {'text': 'This sentence of @w@ number @k@ stays as it is in the text.\n\n@k@ people\n\nvisited the harbour last year\n\nThis line of @w@ is too long to be merged with the one after it.\n\nThe end of the text.'},
            {'llm_text': 'This sentence of @w@ number @k@ stays as it is in the text.\n\n@k@ people visited the harbour last year\n\nThis line of @w@ is too long to be merged with the one after it.\n\nThe end of the text.', 'links': '[]'},
        ),
    ),
    Case(
        'llm_header', 'page', 'LLM-00 LLM-33',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': "<html lang='en'><head><title>Title @k@</title><meta name='description' content='About @w@'><meta name='author' content='Ann'><meta name='date' content='2020'></head><body><article><p>Harbour words of @w@ number @k@.</p></article></body></html>"},
            {'llm_text': '> URL: https://site@k@.example.com/a/b\n> Title: Title @k@\n> Description: About @w@\n> Author: Ann\n> Published: 2020\n> Language: en\n> Word count: 6\n\nHarbour words of @w@ number @k@.'},
        ),
    ),
    Case(
        'llm_labels', 'page', 'LLM-34',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': "<body><article><p>Text of @w@ with <a href='https://x.example.com/1'>**The** guide, opens in a new tab</a> and <a href='https://x.example.com/2'>Harbour @k@ Harbour @k@</a> and <a href='https://x.example.com/3'>A very long label that goes on and on about the harbour, the cranes and the nets of @w@ until it is cut</a>.</p></article></body>"},
            {'llm_text': '> URL: https://site@k@.example.com/a/b\n> Word count: 40\n\nText of @w@ with The guide and Harbour @k@ and A very long label that goes on and on about the harbour, the cranes and the nets of @w@ until it is cut.\n\n## Links\n- The guide: https://x.example.com/1\n- Harbour @k@: https://x.example.com/2\n- A very long label that goes on and on about the harbour, the cranes and the...: https://x.example.com/3'},
        ),
    ),
    Case(
        'llm_structured', 'page', 'LLM-35 FLT-12',
        (
            {'url': 'https://site@k@.example.com/a/b', 'html': '<body><script type=\'application/ld+json\'>{"@type":"Product","name":"P @k@","articleBody":"gone","description":"dddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddddd","brand":{"text":"short @w@"}}</script><script type=\'application/ld+json\'>{"@type":"WebSite","name":"gone"}</script><article><p>Words of @w@ number @k@.</p></article></body>'},
            {'llm_text': '> URL: https://site@k@.example.com/a/b\n> Word count: 5\n\nWords of @w@ number @k@.\n\n## Structured Data\n\n```json\n[\n  {\n    "@type": "Product",\n    "brand": {\n      "text": "short @w@"\n    },\n    "name": "P @k@"\n  }\n]\n```'},
        ),
    ),
    Case(
        'vx_reddit', 'record', 'VX-01',
        (
            {'url': 'https://old.reddit.com/r/harbour/comments/p@k@/x/', 'payload': "<html><body><div id='siteTable'><div class='thing link self' data-fullname='t3_p@k@' data-author='op@w@' data-subreddit='harbour' data-score='@k@' data-comments-count='2' data-permalink='/r/harbour/comments/p@k@/x/'><div class='entry'><p class='title'><a class='title' href='/x'>Post @k@</a></p><div class='expando'><form class='usertext'><div class='usertext-body'><div class='md'><p>Body of <strong>@w@</strong></p></div></div></form></div></div></div></div><div class='commentarea'><div class='sitetable nestedlisting'><div class='thing comment ' data-fullname='t1_a' data-author='ann'><div class='entry'><span class='score unvoted' title='5'>5 points</span><form class='usertext'><div class='usertext-body'><div class='md'><p>First @k@</p></div></div></form></div><div class='child'><div class='sitetable listing'><div class='thing comment ' data-fullname='t1_b' data-author='op@w@'><div class='entry'><span class='score unvoted' title='5'>5 points</span><form class='usertext'><div class='usertext-body'><div class='md'><p>Reply <em>@w@</em></p><blockquote><p>q</p></blockquote></div></div></form></div><div class='child'><div class='sitetable listing'></div></div></div></div></div></div><div class='thing comment deleted' data-fullname='t1_c' data-author=''><div class='entry'><span class='score unvoted' title='5'>5 points</span><form class='usertext'><div class='usertext-body'><div class='md'></div></div></form></div><div class='child'><div class='sitetable listing'></div></div></div></div></div></body></html>"},
            {'record': '{"comments":[{"author":"ann","body":"First @k@","created_utc":null,"depth":0,"id":"a","is_op":false,"replies":[{"author":"op@w@","body":"Reply *@w@*\\n\\n> q","created_utc":null,"depth":1,"id":"b","is_op":true,"replies":[],"score":5}],"score":5},{"author":"[deleted]","body":"[removed]","created_utc":null,"depth":0,"id":"c","is_op":false,"replies":[],"score":5}],"post":{"author":"op@w@","body":"Body of **@w@**","created_utc":null,"flair":null,"id":"p@k@","is_self":true,"num_comments":2,"permalink":"https://old.reddit.com/r/harbour/comments/p@k@/x/","score":@k@,"subreddit":"harbour","title":"Post @k@","url":null},"url":"https://old.reddit.com/r/harbour/comments/p@k@/x/"}', 'error': None},
        ),
        (
            {'url': 'https://www.reddit.com/r/h/comments/@k@/y/', 'payload': '<p>no thread</p>'},
            {'record': None, 'error': 'reddit: no thread in the page'},
        ),
        options={'vertical': 'reddit'},
    ),
    Case(
        'vx_github_repo', 'record', 'VX-03',
        (
            {'url': 'https://github.com/o@w@/r@k@', 'payload': '{"name":"r@k@","full_name":"o@w@/r@k@","owner":{"login":"o@w@"},"description":null,"stargazers_count":@k@,"forks_count":2,"subscribers_count":3,"open_issues_count":4,"size":5,"topics":["a","@w@"],"license":{"spdx_id":"MIT","name":"MIT License"},"archived":false,"fork":true,"default_branch":"main"}'},
            {'record': '{"archived":false,"created_at":null,"default_branch":"main","description":null,"fork":true,"forks":2,"full_name":"o@w@/r@k@","has_discussions":null,"has_issues":null,"has_pages":null,"has_wiki":null,"homepage":null,"html_url":null,"is_template":null,"language":null,"license":"MIT","license_name":"MIT License","name":"r@k@","open_issues":4,"owner":"o@w@","pushed_at":null,"size_kb":5,"stars":@k@,"topics":["a","@w@"],"updated_at":null,"url":"https://github.com/o@w@/r@k@","watchers":3}', 'error': None},
        ),
        (
            {'url': 'https://github.com/o@w@/r@k@/tree/main', 'payload': '{}'},
            {'record': None, 'error': 'the URL does not belong to github_repo'},
        ),
        options={'vertical': 'github_repo'},
    ),
    Case(
        'vx_github_pr', 'record', 'VX-04',
        (
            {'url': 'https://github.com/o@w@/r@k@/pull/@k@', 'payload': '{"number":@k@,"title":"Fix @w@","state":"closed","merged":true,"user":{"login":"ann"},"labels":[{"name":"bug"},{"name":"@w@"}],"head":{"ref":"h","sha":"s"},"base":{"ref":"b"},"additions":1,"deletions":2}'},
            {'record': '{"additions":1,"author":"ann","base_ref":"b","body":null,"changed_files":null,"closed_at":null,"comments":null,"commits":null,"created_at":null,"deletions":2,"draft":null,"head_ref":"h","head_sha":"s","html_url":null,"labels":["bug","@w@"],"merge_commit_sha":null,"merged":true,"merged_at":null,"milestone":null,"number":@k@,"owner":"o@w@","repo":"r@k@","review_comments":null,"state":"closed","title":"Fix @w@","updated_at":null,"url":"https://github.com/o@w@/r@k@/pull/@k@"}', 'error': None},
        ),
        options={'vertical': 'github_pr'},
    ),
    Case(
        'vx_github_issue', 'record', 'VX-05',
        (
            {'url': 'https://github.com/o@w@/r@k@/issues/@k@', 'payload': '{"number":@k@,"title":"Bug in @w@","state":"open","user":{"login":"ann"},"labels":[{"name":"bug"}],"assignees":[{"login":"bob"}],"comments":3,"locked":false}'},
            {'record': '{"assignees":["bob"],"author":"ann","body":null,"closed_at":null,"comments":3,"created_at":null,"html_url":null,"labels":["bug"],"locked":false,"milestone":null,"number":@k@,"owner":"o@w@","repo":"r@k@","state":"open","state_reason":null,"title":"Bug in @w@","updated_at":null,"url":"https://github.com/o@w@/r@k@/issues/@k@"}', 'error': None},
        ),
        (
            {'url': 'https://github.com/o@w@/r@k@/issues/@k@', 'payload': '{"number":@k@,"pull_request":{}}'},
            {'record': None, 'error': 'github_issue: a pull request, not an issue'},
        ),
        options={'vertical': 'github_issue'},
    ),
    Case(
        'vx_github_release', 'record', 'VX-06',
        (
            {'url': 'https://github.com/o@w@/r@k@/releases/tag/v@k@', 'payload': '{"tag_name":"v@k@","name":"Release @w@","draft":false,"author":{"login":"ann"},"assets":[{"name":"a.zip","size":10,"download_count":0},{"name":"b.zip","size":20,"download_count":@k@}]}'},
            {'record': '{"asset_count":2,"assets":[{"browser_download_url":null,"content_type":null,"created_at":null,"download_count":0,"name":"a.zip","size":10,"updated_at":null},{"browser_download_url":null,"content_type":null,"created_at":null,"download_count":@k@,"name":"b.zip","size":20,"updated_at":null}],"author":"ann","body":null,"created_at":null,"draft":false,"html_url":null,"name":"Release @w@","owner":"o@w@","prerelease":null,"published_at":null,"repo":"r@k@","tag_name":"v@k@","total_downloads":@k@,"url":"https://github.com/o@w@/r@k@/releases/tag/v@k@"}', 'error': None},
        ),
        options={'vertical': 'github_release'},
    ),
    Case(
        'vx_pypi', 'record', 'VX-07',
        (
            {'url': 'https://pypi.org/project/p@k@/', 'payload': '{"info":{"name":"p@k@","version":"1.0","summary":"S @w@","home_page":"h","classifiers":["License :: OSI Approved","License :: OSI Approved :: MIT License","Topic :: @w@"],"yanked":false},"releases":{"0.9":[{"upload_time":"2019"}],"1.0":[{"upload_time":"2020-01"},{"upload_time":"2020-02"}]}}'},
            {'record': '{"author":null,"author_email":null,"classifiers":["License :: OSI Approved","License :: OSI Approved :: MIT License","Topic :: @w@"],"homepage":"h","keywords":null,"latest_release_date":"2020-02","license":null,"license_classifier":"License :: OSI Approved :: MIT License","maintainer":null,"name":"p@k@","project_urls":null,"release_count":2,"requires_dist":null,"requires_python":null,"summary":"S @w@","url":"https://pypi.org/project/p@k@/","version":"1.0","yanked":false,"yanked_reason":null}', 'error': None},
        ),
        options={'vertical': 'pypi'},
    ),
    Case(
        'vx_npm', 'record', 'VX-08',
        (
            {'url': 'https://www.npmjs.com/package/@scope/p@k@', 'payload': '{"name":"p@k@","description":"D @w@","dist-tags":{"latest":"2.0.0"},"versions":{"1.0.0":{},"2.0.0":{"license":"MIT","dependencies":{"a":"1"}}},"time":{"2.0.0":"2020"},"maintainers":[{"name":"ann","email":"e"}],"keywords":["@w@"]}', 'second': '{"downloads":@k@}'},
            {'record': '{"dependencies":{"a":"1"},"deprecated":null,"description":"D @w@","dev_dependencies":null,"homepage":null,"keywords":["@w@"],"latest_release_date":"2020","latest_version":"2.0.0","license":"MIT","maintainers":[{"email":"e","name":"ann"}],"name":"p@k@","peer_dependencies":null,"release_count":2,"repository":null,"url":"https://www.npmjs.com/package/@scope/p@k@","weekly_downloads":@k@}', 'error': None},
        ),
        (
            {'url': 'https://www.npmjs.com/package/p@k@', 'payload': '{"versions":{"1.0.0":{}}}'},
            {'record': '{"dependencies":null,"deprecated":null,"description":null,"dev_dependencies":null,"homepage":null,"keywords":null,"latest_release_date":null,"latest_version":"1.0.0","license":null,"maintainers":null,"name":"p@k@","peer_dependencies":null,"release_count":1,"repository":null,"url":"https://www.npmjs.com/package/p@k@","weekly_downloads":null}', 'error': None},
        ),
        options={'vertical': 'npm'},
    ),
    Case(
        'vx_crates_io', 'record', 'VX-09',
        (
            {'url': 'https://crates.io/crates/c@k@', 'payload': '{"crate":{"id":"c@k@","description":"D @w@","downloads":@k@,"categories":["x"],"keywords":["@w@"],"max_version":"1.1.0"},"versions":[{"yanked":true,"license":"A"},{"yanked":false,"license":"MIT","created_at":"2020","rust_version":"1.60"}]}'},
            {'record': '{"categories":["x"],"created_at":null,"description":"D @w@","documentation":null,"downloads":@k@,"homepage":null,"keywords":["@w@"],"latest_license":"MIT","latest_release_date":"2020","latest_rust_version":"1.60","latest_yanked":false,"max_stable_version":null,"max_version":"1.1.0","name":"c@k@","newest_version":null,"recent_downloads":null,"release_count":2,"repository":null,"updated_at":null,"url":"https://crates.io/crates/c@k@"}', 'error': None},
        ),
        options={'vertical': 'crates_io'},
    ),
    Case(
        'vx_huggingface_model', 'record', 'VX-10',
        (
            {'url': 'https://huggingface.co/o@w@/m@k@', 'payload': '{"id":"o@w@/m@k@","modelId":"o@w@/m@k@","private":false,"downloads":@k@,"likes":2,"tags":["t"],"pipeline_tag":"text","cardData":{"license":"mit","language":"en","base_model":"b"},"siblings":[{"rfilename":"a.bin","size":3}]}'},
            {'record': '{"base_model":"b","created_at":null,"datasets":null,"downloads":@k@,"downloads_30d":null,"file_count":1,"files":[{"rfilename":"a.bin","size":3}],"gated":null,"id":"o@w@/m@k@","language":"en","last_modified":null,"library_name":null,"license":"mit","likes":2,"model_id":"o@w@/m@k@","model_type":null,"pipeline_tag":"text","private":false,"sha":null,"tags":["t"],"url":"https://huggingface.co/o@w@/m@k@"}', 'error': None},
        ),
        options={'vertical': 'huggingface_model'},
    ),
    Case(
        'vx_huggingface_dataset', 'record', 'VX-11',
        (
            {'url': 'https://huggingface.co/datasets/o@w@/d@k@', 'payload': '{"id":"o@w@/d@k@","downloads":@k@,"cardData":{"task_categories":["qa"],"size_categories":["1K"]},"siblings":[]}'},
            {'record': '{"annotations_creators":null,"configs":null,"created_at":null,"downloads":@k@,"downloads_30d":null,"file_count":0,"files":[],"gated":null,"id":"o@w@/d@k@","language":null,"last_modified":null,"license":null,"likes":null,"private":null,"sha":null,"size_categories":["1K"],"tags":[],"task_categories":["qa"],"url":"https://huggingface.co/datasets/o@w@/d@k@"}', 'error': None},
        ),
        options={'vertical': 'huggingface_dataset'},
    ),
    Case(
        'vx_arxiv', 'record', 'VX-12',
        (
            {'url': 'https://arxiv.org/abs/2001.@k@v2', 'payload': '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id> http://arxiv.org/abs/2001.@k@v2 </id><title>Title @w@</title><summary> An\n abstract  of @k@ </summary><published>2020</published><author><name>Ann</name></author><author><name>Bob @w@</name></author><category term="cs.CL"/><category term="cs.DB"/><link rel="alternate" href="https://arxiv.org/abs/2001.@k@v2"/><link type="application/pdf" href="https://arxiv.org/pdf/2001.@k@v2"/></entry></feed>'},
            {'record': '{"abs_url":"https://arxiv.org/abs/2001.@k@v2","abstract":"An abstract of @k@","arxiv_id":"http://arxiv.org/abs/2001.@k@v2","authors":["Ann","Bob @w@"],"categories":["cs.CL","cs.DB"],"comment":null,"doi":null,"id":"2001.@k@","pdf_url":"https://arxiv.org/pdf/2001.@k@v2","primary_category":"cs.CL","published":"2020","title":"Title @w@","updated":null,"url":"https://arxiv.org/abs/2001.@k@v2"}', 'error': None},
        ),
        (
            {'url': 'https://arxiv.org/pdf/2001.@k@.pdf', 'payload': '<feed></feed>'},
            {'record': None, 'error': 'arxiv: no entry in the feed'},
        ),
        options={'vertical': 'arxiv'},
    ),
    Case(
        'vx_docker_hub', 'record', 'VX-13',
        (
            {'url': 'https://hub.docker.com/r/o@w@/i@k@', 'payload': '{"namespace":"o@w@","name":"i@k@","pull_count":@k@,"star_count":2,"description":"D","categories":[{"name":"Data","slug":"data"}]}'},
            {'record': '{"categories":[{"name":"Data","slug":"data"}],"date_registered":null,"description":"D","full_description":null,"full_name":"o@w@/i@k@","is_official":false,"is_private":null,"last_updated":null,"name":"i@k@","namespace":"o@w@","pull_count":@k@,"star_count":2,"status_description":null,"url":"https://hub.docker.com/r/o@w@/i@k@"}', 'error': None},
        ),
        (
            {'url': 'https://hub.docker.com/_/i@k@', 'payload': '{"namespace":"library","name":"i@k@"}'},
            {'record': '{"categories":[],"date_registered":null,"description":null,"full_description":null,"full_name":"library/i@k@","is_official":true,"is_private":null,"last_updated":null,"name":"i@k@","namespace":"library","pull_count":null,"star_count":null,"status_description":null,"url":"https://hub.docker.com/_/i@k@"}', 'error': None},
        ),
        options={'vertical': 'docker_hub'},
    ),
    Case(
        'vx_dev_to', 'record', 'VX-14',
        (
            {'url': 'https://dev.to/ann@w@/post-@k@', 'payload': '{"id":@k@,"title":"T @w@","canonical_url":"c","reading_time_minutes":3,"tag_list":["a"],"positive_reactions_count":5,"user":{"username":"ann@w@","name":"Ann","github_username":"g"}}'},
            {'record': '{"author":{"github":"g","name":"Ann","twitter":null,"username":"ann@w@","website":null},"body_markdown":null,"comments_count":null,"cover_image":null,"description":null,"edited_at":null,"id":@k@,"page_views_count":null,"positive_reactions":5,"public_reactions":null,"published_at":null,"reading_time_min":3,"tags":["a"],"title":"T @w@","url":"https://dev.to/ann@w@/post-@k@","url_canonical":"c"}', 'error': None},
        ),
        options={'vertical': 'dev_to'},
    ),
    Case(
        'vx_stackoverflow', 'record', 'VX-15',
        (
            {'url': 'https://stackoverflow.com/questions/@k@/how', 'payload': '{"items":[{"question_id":@k@,"title":"How @w@","tags":["sql"],"score":3,"answer_count":2,"owner":{"display_name":"Ann","reputation":9}}]}', 'second': '{"items":[{"answer_id":1,"is_accepted":false,"score":1},{"answer_id":2,"is_accepted":true,"score":@k@,"owner":{"display_name":"Bob"}}]}'},
            {'record': '{"accepted_answer":{"answer_id":2,"author":"Bob","author_rep":null,"body":null,"creation_date":null,"is_accepted":true,"last_edit_date":null,"score":@k@},"accepted_answer_id":null,"answer_count":2,"author":"Ann","author_rep":9,"body":null,"creation_date":null,"is_answered":null,"last_activity_date":null,"link":null,"question_id":@k@,"score":3,"tags":["sql"],"title":"How @w@","top_answers":[{"answer_id":1,"author":null,"author_rep":null,"body":null,"creation_date":null,"is_accepted":false,"last_edit_date":null,"score":1},{"answer_id":2,"author":"Bob","author_rep":null,"body":null,"creation_date":null,"is_accepted":true,"last_edit_date":null,"score":@k@}],"url":"https://stackoverflow.com/questions/@k@/how","view_count":null}', 'error': None},
        ),
        (
            {'url': 'https://stackoverflow.com/questions/@k@', 'payload': '{"items":[]}'},
            {'record': None, 'error': 'stackoverflow: no such question'},
        ),
        options={'vertical': 'stackoverflow'},
    ),
    Case(
        'vx_linkedin_post', 'record', 'VX-18',
        (
            {'url': 'https://www.linkedin.com/posts/ann_topic-123456789012345@k@-AbCd', 'payload': '<html><head><title>Post | Ann @w@</title><meta property=\'x\' content="y"><meta property="og:title" content="T &amp; @k@"></head><p dir="ltr" class="attributed-text-segment-list__content x">Body <b>@w@</b> text</p></html>'},
            {'record': '{"author_name":"Ann @w@","body":"Body @w@ text","canonical_url":"https://www.linkedin.com/embed/feed/update/urn:li:activity:123456789012345@k@","data_completeness":"embed","embed_url":"https://www.linkedin.com/embed/feed/update/urn:li:activity:123456789012345@k@","image_url":null,"site_name":"LinkedIn","title":"T & @k@","url":"https://www.linkedin.com/posts/ann_topic-123456789012345@k@-AbCd","urn":"urn:li:activity:123456789012345@k@"}', 'error': None},
        ),
        options={'vertical': 'linkedin_post'},
    ),
    Case(
        'vx_instagram_post', 'record', 'VX-19',
        (
            {'url': 'https://www.instagram.com/reels/C@k@/', 'payload': '<div class="Caption"><a href="x" class="CaptionUsername">ann@w@</a><br>Caption &amp; @k@</div><img class="EmbeddedMediaImage" src="https://i.example.com/@k@.jpg">'},
            {'record': '{"author_username":"ann@w@","canonical_url":"https://www.instagram.com/reel/C@k@/","caption":"Caption & @k@","data_completeness":"embed","embed_url":"https://www.instagram.com/p/C@k@/embed/captioned/","kind":"reel","shortcode":"C@k@","thumbnail_url":"https://i.example.com/@k@.jpg","url":"https://www.instagram.com/reels/C@k@/"}', 'error': None},
        ),
        options={'vertical': 'instagram_post'},
    ),
    Case(
        'vx_instagram_profile', 'record', 'VX-20',
        (
            {'url': 'https://www.instagram.com/ann@k@/', 'payload': '<html><meta property="og:title" content="Ann @w@ (ann@k@)"><meta property="og:description" content="1.5K Followers, 20 Following, 1,234 Posts"></html>'},
            {'record': '{"biography":null,"canonical_url":"https://www.instagram.com/ann@k@/","data_completeness":"og_only","follower_count":1500,"following_count":20,"full_name":"Ann @w@","is_business":null,"is_verified":null,"post_count":1234,"profile_pic_url":null,"recent_posts":[],"url":"https://www.instagram.com/ann@k@/","username":"ann@k@"}', 'error': None},
        ),
        (
            {'url': 'https://www.instagram.com/ann@k@/', 'payload': '{"data":{"user":{"id":"@k@","username":"ann@k@","full_name":"Ann @w@","edge_followed_by":{"count":@k@},"edge_owner_to_timeline_media":{"count":1,"edges":[{"node":{"__typename":"GraphVideo","shortcode":"s@k@","is_video":true,"display_url":"d"}}]}}}}'},
            {'record': '{"biography":null,"biography_links":null,"canonical_url":"https://www.instagram.com/ann@k@/","category":null,"data_completeness":"api","external_url":null,"follower_count":@k@,"following_count":null,"full_name":"Ann @w@","is_business":null,"is_private":null,"is_professional":null,"is_verified":null,"post_count":1,"profile_pic_url":null,"recent_posts":[{"alt_text":null,"caption":null,"comment_count":null,"dimensions":null,"display_url":"d","is_video":true,"kind":"video","like_count":null,"product_type":null,"shortcode":"s@k@","taken_at":null,"thumbnail_url":"d","url":"https://www.instagram.com/p/s@k@/","video_views":null}],"url":"https://www.instagram.com/ann@k@/","user_id":"@k@","username":"ann@k@"}', 'error': None},
        ),
        options={'vertical': 'instagram_profile'},
    ),
    Case(
        'vx_amazon_product', 'record', 'VX-25',
        (
            {'url': 'https://www.amazon.de/x/dp/B0000@k@', 'payload': '<html><script type="application/ld+json">{"@type":"Product","name":"Prod @w@","sku":"s@k@","brand":{"name":"Brand"},"image":["i.png"],"offers":{"price":@k@.5,"priceCurrency":"EUR","availability":"https://schema.org/InStock","itemCondition":"http://schema.org/NewCondition","seller":{"name":"Shop"}},"aggregateRating":{"ratingValue":"4.5","reviewCount":12}}</script><span id="productTitle"> Shown @w@ </span></html>'},
            {'record': '{"aggregate_rating":{"best_rating":null,"rating_value":"4.5","review_count":"12"},"asin":"B0000@k@","availability":"InStock","brand":"Brand","condition":"NewCondition","currency":"EUR","data_source":"local","description":null,"image":"i.png","mpn":null,"price":"@k@.5","sku":"s@k@","title":"Prod @w@","url":"https://www.amazon.de/x/dp/B0000@k@"}', 'error': None},
        ),
        (
            {'url': 'https://www.amazon.com/dp/B0000@k@?x', 'payload': '<html><span id="productTitle"> Shown @w@ </span><meta property="og:description" content="D &amp; @k@"></html>'},
            {'record': '{"aggregate_rating":null,"asin":"B0000@k@","availability":null,"brand":null,"condition":null,"currency":null,"data_source":"local","description":"D & @k@","image":null,"mpn":null,"price":null,"sku":null,"title":"Shown @w@","url":"https://www.amazon.com/dp/B0000@k@?x"}', 'error': None},
        ),
        options={'vertical': 'amazon_product'},
    ),
    Case(
        'vx_ebay_listing', 'record', 'VX-26',
        (
            {'url': 'https://www.ebay.com/itm/123@k@', 'payload': '<html><script type="application/ld+json">{"@type":"Product","name":"Prod @w@","sku":"s@k@","brand":{"name":"Brand"},"image":["i.png"],"offers":{"price":@k@.5,"priceCurrency":"EUR","availability":"https://schema.org/InStock","itemCondition":"http://schema.org/NewCondition","seller":{"name":"Shop"}},"aggregateRating":{"ratingValue":"4.5","reviewCount":12}}</script></html>'},
            {'record': '{"aggregate_rating":{"best_rating":null,"rating_value":"4.5","review_count":"12"},"availability":"InStock","brand":"Brand","condition":"NewCondition","currency":"EUR","data_source":"local","description":null,"high_price":null,"image":"i.png","item_id":"123@k@","low_price":null,"offer_count":null,"price":"@k@.5","seller":"Shop","title":"Prod @w@","url":"https://www.ebay.com/itm/123@k@"}', 'error': None},
        ),
        options={'vertical': 'ebay_listing'},
    ),
    Case(
        'vx_etsy_listing', 'record', 'VX-27',
        (
            {'url': 'https://www.etsy.com/listing/10@k@/hand-made_item', 'payload': '<html><script type="application/ld+json">{"@type":"Product","name":"Prod @w@","sku":"s@k@","brand":{"name":"Brand"},"image":["i.png"],"offers":{"price":@k@.5,"priceCurrency":"EUR","availability":"https://schema.org/InStock","itemCondition":"http://schema.org/NewCondition","seller":{"name":"Shop"}},"aggregateRating":{"ratingValue":"4.5","reviewCount":12}}</script><a href="/shop/Shop@k@">s</a></html>'},
            {'record': '{"aggregate_rating":{"best_rating":null,"rating_value":"4.5","review_count":"12"},"availability":"InStock","brand":"Brand","currency":"EUR","data_source":"local","description":null,"high_price":null,"image":"i.png","item_condition":null,"listing_id":"10@k@","low_price":null,"price":"@k@.5","shop":"Shop","shop_url":"https://www.etsy.com/shop/Shop@k@","title":"Prod @w@","url":"https://www.etsy.com/listing/10@k@/hand-made_item"}', 'error': None},
        ),
        (
            {'url': 'https://www.etsy.com/listing/10@k@/hand-made_item', 'payload': '<html><meta property="og:title" content="Etsy - home"></html>'},
            {'record': '{"aggregate_rating":null,"availability":null,"brand":null,"currency":null,"data_source":"local","description":null,"high_price":null,"image":null,"item_condition":null,"listing_id":"10@k@","low_price":null,"price":null,"shop":null,"shop_url":null,"title":"Hand Made Item","url":"https://www.etsy.com/listing/10@k@/hand-made_item"}', 'error': None},
        ),
        options={'vertical': 'etsy_listing'},
    ),
    Case(
        'vx_trustpilot_reviews', 'record', 'VX-28',
        (
            {'url': 'https://www.trustpilot.com/review/s@k@.example.com', 'payload': '<meta property="og:title" content="Shop @w@ is rated &quot;Great&quot; with 4.2 / 5"><meta property="og:description" content="Join the 1,234 customers"><script type="application/ld+json">{"@graph":[{"@type":"Dataset","name":"Shop @w@","about":{"@id":"x/Organization/s@k@.example.com"},"mainEntity":{"csvw:tableSchema":{"csvw:columns":[{"csvw:name":"1 star","csvw:cells":[{"csvw:value":"1","csvw:notes":["10%"]}]},{"csvw:name":"5 stars","csvw:cells":[{"csvw:value":"3"}]},{"csvw:name":"Total","csvw:cells":[{"csvw:value":"@k@"}]}]}}},{"aiSummary":{"summary":"Fine"},"aiSummaryReviews":[{"id":"r","rating":5,"consumer":{"displayName":"Ann"}}]}]}</script>'},
            {'record': '{"ai_summary":"Fine","average_rating":"4.0","business_name":"Shop @w@","data_source":"local","domain":"s@k@.example.com","rating_distribution":{"five_stars":{"count":3,"percent":null},"one_star":{"count":1,"percent":"10%"},"total":{"count":@k@,"percent":null}},"rating_label":"Great","recent_reviews":[{"author":"Ann","author_country":null,"author_review_count":null,"date_experienced":null,"date_published":null,"id":"r","language":null,"likes":null,"rating":5,"source":null,"text":null,"title":null,"verified":null}],"review_count":@k@,"review_count_listed":1,"url":"https://www.trustpilot.com/review/s@k@.example.com"}', 'error': None},
        ),
        (
            {'url': 'https://www.trustpilot.com/review/s@k@.example.com', 'payload': '<meta property="og:title" content="Shop @w@ is rated &quot;Great&quot; with 4.2 / 5"><meta property="og:description" content="Join the 1,234 customers">'},
            {'record': '{"ai_summary":null,"average_rating":"4.2","business_name":"Shop @w@","data_source":"local","domain":"s@k@.example.com","rating_distribution":null,"rating_label":"Great","recent_reviews":[],"review_count":1234,"review_count_listed":0,"url":"https://www.trustpilot.com/review/s@k@.example.com"}', 'error': None},
        ),
        options={'vertical': 'trustpilot_reviews'},
    ),
    Case(
        'vx_youtube_video', 'record', 'VX-17',
        (
            {'url': 'https://youtu.be/v@k@?t=1', 'payload': '<script>var ytInitialPlayerResponse = {"videoDetails":{"title":"Video @k@","author":"Ch @w@","viewCount":"12345","lengthSeconds":"3725","shortDescription":"About @w@"},"microformat":{"playerMicroformatRenderer":{"uploadDate":"2020-05-06"}},"captions":{"playerCaptionsTracklistRenderer":{"captionTracks":[{"baseUrl":"https://c.example.com/@k@","languageCode":"en","name":{"simpleText":"English"}}]}}};</script>'},
            {'record': '{"allow_ratings":null,"author":"Ch @w@","canonical_url":"https://www.youtube.com/watch?v=v@k@","caption_tracks":[{"lang":"en","name":"English","url":"https://c.example.com/@k@"}],"category":null,"channel_id":null,"channel_url":null,"data_source":"player_response","description":"About @w@","is_live":null,"is_private":null,"is_unlisted":null,"keywords":[],"length_seconds":3725,"publish_date":null,"thumbnails":[],"title":"Video @k@","upload_date":"2020-05-06","url":"https://youtu.be/v@k@?t=1","video_id":"v@k@","view_count":12345}', 'error': None},
        ),
        (
            {'url': 'https://www.youtube.com/watch?a=b&v=v@k@', 'payload': '<meta property="og:title" content="OG @w@"><meta property="og:image" content="i.png"><meta name="author" content="Ann">'},
            {'record': '{"allow_ratings":null,"author":"Ann","canonical_url":"https://www.youtube.com/watch?v=v@k@","caption_tracks":[],"category":null,"channel_id":null,"channel_url":null,"data_source":"og_fallback","description":null,"is_live":null,"is_private":null,"is_unlisted":null,"keywords":[],"length_seconds":null,"publish_date":null,"thumbnails":[{"url":"i.png"}],"title":"OG @w@","upload_date":null,"url":"https://www.youtube.com/watch?a=b&v=v@k@","video_id":"v@k@","view_count":null}', 'error': None},
        ),
        options={'vertical': 'youtube_video'},
    ),
    Case(
        'vx_chronopost', 'record', 'VX-29',
        (
            {'url': 'https://www.chronopost.fr/tracking?listeNumerosLT=X@k@&langue=fr', 'payload': '{"top":"<div class=\\"ch-suivi-colis-light-info\\"><div class=\\"ch-suivi-colis-light-text\\">Sent @w@</div></div><div class=\\"ch-suivi-colis-light-info active\\"><div class=\\"ch-suivi-colis-light-text\\">On its way</div></div>","tab":"<tr><td>1/2<br>10:00</td><td>Paris<br>Left &amp; gone @k@</td><td>d</td></tr>"}'},
            {'record': '{"event_count":1,"events":[{"date":"1/2","details":"d","event":"Left & gone @k@","office":"Paris","time":"10:00"}],"language":"fr","source_url":"https://www.chronopost.fr/tracking?listeNumerosLT=X@k@&langue=fr","status":"On its way","steps":[{"label":"Sent @w@","state":"completed"},{"label":"On its way","state":"current"}],"tracking_number":"X@k@"}', 'error': None},
        ),
        (
            {'url': 'https://www.chronopost.fr/tracking?listeNumerosLT=X@k@', 'payload': '{"error":"No parcel @k@"}'},
            {'record': None, 'error': 'chronopost: No parcel @k@'},
        ),
        options={'vertical': 'chronopost'},
    ),
    Case(
        'vx_shopify_product', 'record', 'VX-21',
        (
            {'url': 'https://shop.example.com/products/p@k@?v=1', 'payload': '{"product":{"id":@k@,"title":"T @w@","variants":[{"id":1,"price":"10.50","available":false},{"id":2,"price":"@k@.00","available":true}],"images":[{"src":"i.png"}],"options":[{"name":"Size","values":["S","M"]}]}}'},
            {'record': '{"any_available":true,"created_at":null,"description_html":null,"handle":null,"image_count":1,"images":[{"alt":null,"height":null,"position":null,"src":"i.png","width":null}],"json_url":"https://shop.example.com/products/p@k@.json?v=1","options":[{"name":"Size","position":null,"values":["S","M"]}],"price_max":@k@.0,"price_min":10.5,"product_id":@k@,"product_type":null,"published_at":null,"tags":null,"title":"T @w@","updated_at":null,"url":"https://shop.example.com/products/p@k@?v=1","variant_count":2,"variants":[{"available":false,"barcode":null,"compare_at_price":null,"id":1,"inventory_quantity":null,"option1":null,"option2":null,"option3":null,"position":null,"price":"10.50","requires_shipping":null,"sku":null,"taxable":null,"title":null,"weight":null,"weight_unit":null},{"available":true,"barcode":null,"compare_at_price":null,"id":2,"inventory_quantity":null,"option1":null,"option2":null,"option3":null,"position":null,"price":"@k@.00","requires_shipping":null,"sku":null,"taxable":null,"title":null,"weight":null,"weight_unit":null}],"vendor":null}', 'error': None},
        ),
        options={'vertical': 'shopify_product'},
    ),
    Case(
        'vx_shopify_collection', 'record', 'VX-22',
        (
            {'url': 'https://shop.example.com/collections/c@k@?x=1', 'payload': '{"collection":{"id":@k@,"title":"C @w@"}}', 'second': '{"products":[{"id":1,"title":"P @k@","variants":[{"price":"5","available":true}],"images":[]}]}'},
            {'record': '{"collection_id":@k@,"description_html":null,"handle":null,"meta_json_url":"https://shop.example.com/collections/c@k@.json","products":[{"available":true,"compare_at_price":null,"created_at":null,"handle":null,"id":1,"image":null,"price":"5","product_type":null,"title":"P @k@","updated_at":null,"variant_count":1,"vendor":null}],"products_in_page":1,"products_json_url":"https://shop.example.com/collections/c@k@/products.json?limit=50","published_at":null,"sort_order":null,"title":"C @w@","updated_at":null,"url":"https://shop.example.com/collections/c@k@?x=1"}', 'error': None},
        ),
        options={'vertical': 'shopify_collection'},
    ),
    Case(
        'vx_ecommerce_product', 'record', 'VX-23 STR-06',
        (
            {'url': 'https://s@k@.example.com/p', 'payload': '<html><script type="application/ld+json">{"@type":"Product","name":"Prod @w@","sku":"s@k@","brand":{"name":"Brand"},"image":["i.png"],"offers":{"price":@k@.5,"priceCurrency":"EUR","availability":"https://schema.org/InStock","itemCondition":"http://schema.org/NewCondition","seller":{"name":"Shop"}},"aggregateRating":{"ratingValue":"4.5","reviewCount":12}}</script></html>'},
            {'record': '{"aggregate_rating":{"best_rating":null,"rating_count":null,"rating_value":"4.5","review_count":"12","worst_rating":null},"brand":"Brand","category":null,"color":null,"data_source":"jsonld","description":null,"gtin":null,"images":["i.png"],"material":null,"mpn":null,"name":"Prod @w@","offers":[{"availability":"InStock","currency":"EUR","high_price":null,"item_condition":"NewCondition","low_price":null,"offer_count":null,"price":"@k@.5","seller":"Shop","url":null,"valid_until":null}],"product_id":null,"raw_jsonld":{"@type":"Product","aggregateRating":{"ratingValue":"4.5","reviewCount":12},"brand":{"name":"Brand"},"image":["i.png"],"name":"Prod @w@","offers":{"availability":"https://schema.org/InStock","itemCondition":"http://schema.org/NewCondition","price":@k@.5,"priceCurrency":"EUR","seller":{"name":"Shop"}},"sku":"s@k@"},"raw_schema_type":"Product","review_count":"12","sku":"s@k@","url":"https://s@k@.example.com/p"}', 'error': None},
        ),
        (
            {'url': 'https://s@k@.example.com/p', 'payload': '<meta property="og:title" content="T @w@"><meta property="product:price:amount" content="@k@"><meta property="product:price:currency" content="EUR">'},
            {'record': '{"aggregate_rating":null,"brand":null,"category":null,"color":null,"data_source":"og_fallback","description":null,"gtin":null,"images":[],"material":null,"mpn":null,"name":"T @w@","offers":[{"availability":null,"currency":"EUR","high_price":null,"item_condition":null,"low_price":null,"offer_count":null,"price":"@k@","seller":null,"url":null,"valid_until":null}],"product_id":null,"raw_jsonld":null,"raw_schema_type":null,"review_count":null,"sku":null,"url":"https://s@k@.example.com/p"}', 'error': None},
        ),
        (
            {'url': 'https://s@k@.example.com/p', 'payload': '<p>nothing @w@</p>'},
            {'record': None, 'error': 'ecommerce_product: no product in the page'},
        ),
        options={'vertical': 'ecommerce_product'},
    ),
    Case(
        'vx_woocommerce_product', 'record', 'VX-24',
        (
            {'url': 'http://s.example.com/shop/p@k@/', 'payload': '[{"id":@k@,"name":"N @w@","prices":{"price":"100","currency_code":"EUR"},"is_in_stock":true,"categories":[{"name":"c"}],"images":[{"src":"i"}],"variations":[1,2]}]'},
            {'record': '{"api_url":"http://s.example.com/wp-json/wc/store/v1/products?slug=p@k@&per_page=1","average_rating":null,"categories":["c"],"currency":"EUR","currency_minor":null,"description":null,"image_count":1,"images":[{"alt":null,"src":"i","thumbnail":null}],"in_stock":true,"is_purchasable":null,"name":"N @w@","on_sale":null,"permalink":null,"price":"100","price_range":null,"product_id":@k@,"regular_price":null,"review_count":null,"sale_price":null,"short_description":null,"sku":null,"slug":null,"tags":[],"url":"http://s.example.com/shop/p@k@/","variation_count":2}', 'error': None},
        ),
        (
            {'url': 'http://s.example.com/shop/p@k@/', 'payload': '[]'},
            {'record': None, 'error': 'woocommerce_product: no such product'},
        ),
        options={'vertical': 'woocommerce_product'},
    ),
    Case(
        'vx_substack_post', 'record', 'VX-16',
        (
            {'url': 'https://ann.substack.com/p/post-@k@', 'payload': '{"id":@k@,"title":"T @w@","audience":"only_paid","wordcount":5,"publication":{"id":1,"name":"Pub"},"publishedBylines":[{"id":2,"name":"Ann","photo_url":"p"}]}'},
            {'record': '{"api_url":"https://ann.substack.com/api/v1/posts/post-@k@","audience":"only_paid","authors":[{"handle":null,"id":2,"name":"Ann","photo":"p"}],"body_html":null,"body_text":null,"canonical_url":null,"comment_count":null,"cover_image":null,"data_source":"api","description":null,"has_paywall":true,"id":@k@,"is_free_preview":null,"post_date":null,"publication":{"custom_domain":null,"id":1,"name":"Pub","subdomain":null},"reactions":null,"slug":"post-@k@","subtitle":null,"title":"T @w@","type":null,"updated_at":null,"url":"https://ann.substack.com/p/post-@k@","word_count":5}', 'error': None},
        ),
        (
            {'url': 'https://ann.substack.com/p/post-@k@', 'payload': '<html><script type="application/ld+json">{"@type":"NewsArticle","headline":"H @k@","author":[{"name":"Ann","url":"https://substack.com/@ann"}],"datePublished":"2020"}</script><meta property="og:site_name" content="Pub @w@"></html>'},
            {'record': '{"api_url":"https://ann.substack.com/api/v1/posts/post-@k@","authors":[{"handle":"ann","name":"Ann"}],"body_html":null,"body_text":null,"canonical_url":"https://ann.substack.com/p/post-@k@","comment_count":null,"cover_image":null,"data_source":"html_fallback","description":null,"fetch_source":"local","has_paywall":null,"is_free_preview":null,"post_date":"2020","publication":{"name":"Pub @w@"},"reactions":null,"slug":"post-@k@","subtitle":null,"title":"H @k@","updated_at":null,"url":"https://ann.substack.com/p/post-@k@","word_count":null}', 'error': None},
        ),
        options={'vertical': 'substack_post'},
    ),)
