"""Labelled pages for training the markup model: made from templates, the labels by construction."""

from __future__ import annotations

import random

_NOUNS = "harbor ridge temple farm street hospital factory island forest gate square barn cellar meadow pier tunnel canyon village".split()
_NAMES = "Alda Brivo Celtran Dorim Elvast Fanor Golem Hestra Ilvan Jorun Kelda Lomir".split()
_TEX = [r"a = b + c", r"\frac{p}{q}", r"x_1 \ge 0", r"n", r"\sum_k c_k", r"y^3 - 1", r"q = 2", r"\gamma \to \delta", r"m"]
_CODE = ["if x:\n    # note\n    return y", "== sample ==\n* point\n# mark", "$u$ or $v$\n\\item zero", "1. one\n2. two", "<h3>none</h3>\n<li>none</li>", "- step\n- stop", "a = {1: 2}"]


class _Page:
    def __init__(self, rng: random.Random):
        self.rng, self.parts, self.spans, self.at = rng, [], [], 0

    def add(self, text: str, label: str | None = None) -> None:
        if label:
            self.spans.append((self.at, self.at + len(text), label))
        self.parts.append(text)
        self.at += len(text)

    def name(self) -> str:
        return " ".join(self.rng.sample(_NAMES, self.rng.choice([1, 2])))

    def title(self) -> str:
        r, n = self.rng, self.rng.choice(_NOUNS).capitalize()
        return r.choice([n, f"{n} and {r.choice(_NOUNS)}", f"{n} of {self.name()}", f"{r.choice([n + "s", "The " + n])} {r.choice(["from", "to", "under", "beside"])} {self.name()}", self.name(), f"The {self.name()}", f"{self.name()} & Co"])

    def point(self) -> str:
        words = self.rng.choices(_NOUNS, k=self.rng.randint(2, 6))
        return " ".join([words[0].capitalize(), *words[1:]])

    def hash_words(self) -> str:
        """A sentence behind a hash sign without blank: no heading, as one needs the blank, and no list."""
        r = self.rng
        first = r.choice([r.choice(_NOUNS), str(r.randint(1, 99))])
        return f"#{first} {r.choice(['of', 'with', 'has no', 'in'])} {r.choice(_NOUNS)}, {r.choice(['*', '_'])}{r.choice(_NOUNS)}{r.choice(['', 's'])}* and {r.randint(1, 9)}.{r.randint(0, 9)} {r.choice(_NOUNS)}s{r.choice(['.', '; x <- y.', ' more.'])}"

    def formula(self, kind: str) -> str:
        t = self.rng.choice(_TEX)
        if kind == "dom":
            esc = t.replace("<", "&lt;")
            return f'<span class="mwe-math-element"><span class="mwe-math-mathml-inline" style="display: none;"><math alttext="{esc}"><semantics><mrow><mi>x</mi></mrow><annotation encoding="application/x-tex">{esc}</annotation></semantics></math></span><img src="f.svg" alt="{esc}"/></span>'
        if kind == "wiki":
            return f"<math>{t}</math>"
        return self.rng.choice([f"${t}$", rf"\({t}\)"])

    def prose(self, kind: str, formulas: bool = True) -> None:
        """A paragraph's sentences in one line; formulas are labelled where they stand."""
        r = self.rng
        for i in range(r.randint(1, 4)):
            self.add(" " if i else "")
            pick = r.random()
            if pick < 0.3 and formulas:
                self.add("Then ")
                self.add(self.formula(kind), "formula")
                self.add(" holds.")
            elif pick < 0.4:
                self.add(rf"It cost {'\\' if kind == 'latex' else ''}$5 more, then {'\\' if kind == 'latex' else ''}$12 less.")
            elif pick < 0.5:
                self.add({"dom": "The <code>area_id</code> is <b>bold</b>.", "wiki": "The '''bold''' [[link|one]] is <code>#x</code>.", "md": "The **bold** [link](http://x.example) is `$x`.", "latex": r"The \textbf{bold} is \texttt{a\_b} \& more."}[kind])
            elif pick < 0.6:
                self.add({"dom": "So 2 &lt; 3, &lt;h2&gt; is a tag.", "latex": r"No \#4 here."}.get(kind, "So 2 < 3 and 4 * 5 is 20, no #4 here."))
            else:
                self.add(f"The {r.choice(_NOUNS)} near {self.name()} was rebuilt in {r.randint(1500, 2020)}.")

    def heading(self, kind: str) -> None:
        r, t, n = self.rng, self.title(), self.rng.randint(1, 4)
        if kind == "dom":
            self.add(f'<h{n}><span class="mw-headline" id="x">{t}</span>' + r.choice(["", '<span class="mw-editsection">[<a href="/e">edit</a>]</span>']) + f"</h{n}>", "heading")
        elif kind == "wiki":
            gap = r.choice(["", " "])
            self.add("=" * n + gap + t + gap + "=" * n, "heading")
        elif kind == "md":
            pick = r.random()
            if pick < 0.3:
                self.add(t, "heading")
                self.add("\n" + r.choice("=-") * max(5, len(t)))
            else:
                self.add("#" * n + " " + t + (" " + "#" * n if pick < 0.5 else ""), "heading")
        else:
            self.add("\\" + r.choice(["", "sub", "subsub"]) + "section" + r.choice(["", "*"]) + "{" + t + "}", "heading")
        self.add("\n\n")

    def listing(self, kind: str) -> None:
        r, n = self.rng, self.rng.randint(1, 6) if self.rng.random() < 0.8 else 2
        if kind == "dom":
            tag = r.choice(["ul", "ol"])
            self.add(f"<{tag}>\n")
            shut = r.choice(["", "</li>"])
            for i in range(n):
                self.add("<li>", "item")
                self.add(self.point())
                if i and r.random() < 0.2:
                    self.add("<ul><li>", None)
                    self.spans.append((self.at - 4, self.at, "item"))
                    self.add(self.point() + "</li></ul>")
                self.add(shut + "\n")
            self.add(f"</{tag}>\n")
            return
        if kind == "latex":
            env = r.choice(["itemize", "enumerate"])
            self.add(f"\\begin{{{env}}}\n")
            for _ in range(n):
                self.add("  \\item " + self.point(), "item")
                self.add("\n")
            self.add(f"\\end{{{env}}}\n\n")
            return
        mark, gap = (r.choice("*#"), r.choice(["", " "])) if kind == "wiki" else (r.choice(["-", "*", "+", "1."]), " ")
        n = max(n, 2) if mark == "#" and r.random() < 0.9 else n
        for i in range(n):
            deep = i > 0 and r.random() < 0.2
            lead = mark * (2 if deep else 1) + gap if kind == "wiki" else ("    " if deep else "") + (f"{i + 1}." if mark == "1." else mark) + gap
            self.add(lead + self.point(), "item")
            self.add("\n")
        self.add("\n")

    def code(self, kind: str) -> None:
        r, c = self.rng, self.rng.choice(_CODE)
        esc = c.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        self.add(
            {
                "dom": r.choice([f"<pre>{esc}</pre>", f'<div class="mw-highlight"><pre><span></span>{esc}\n</pre></div>', f'<pre class="code"><code>{esc}</code></pre>']),
                "wiki": r.choice([f'<syntaxhighlight lang="text">\n{c}\n</syntaxhighlight>', f'<source lang="py">\n{c}\n</source>', f"<pre>\n{c}\n</pre>"]),
                "md": r.choice([f"```\n{c}\n```", f"~~~\n{c}\n~~~", f"```text\n{c}\n```"]),
                "latex": r.choice([f"\\begin{{verbatim}}\n{c}\n\\end{{verbatim}}", f"\\begin{{lstlisting}}\n{c}\n\\end{{lstlisting}}"]),
            }[kind],
            "code",
        )
        self.add("\n\n")

    def display(self, kind: str) -> None:
        r, t = self.rng, self.rng.choice(_TEX)
        if kind == "dom":
            self.add("<dl><dd>")
            self.add(self.formula("dom"), "formula")
            self.add("</dd></dl>\n")
            return
        if kind == "wiki":
            self.add(":")
        self.add({"wiki": f'<math display="block">{t}</math>', "md": r.choice([f"$$\n{t}\n$$", f"$${t}$$", f"\\[ {t} \\]"]), "latex": r.choice([f"\\[ {t} \\]", f"\\begin{{equation}}\n{t}\n\\end{{equation}}", f"\\begin{{align*}}\n{t}\n\\end{{align*}}", f"$$ {t} $$"])}[kind], "formula")
        self.add("\n\n")

    def trap(self, kind: str) -> None:
        """Things that are not shown, or shown as they are."""
        r = self.rng
        if kind == "dom":
            what = r.choice(["comment", "script", "style", "noprint", "table", "empty"])
            if what == "noprint":
                self.add('<div class="noprint"><ul>', None)
                self.add("<li>Print</li><li>Save</li>", "hidden")
                self.add("</ul></div>\n")
            elif what == "table":
                self.add(f'<table class="infobox"><tr><th>Seat</th><td>{self.name()}</td></tr></table>\n')
            elif what == "empty":
                self.add('<p class="mw-empty-elt"></p>\n')
            else:
                self.add({"comment": "<!-- <h2>Old</h2> <li>old</li> $x$ -->", "script": '<script>var s = "<li>$x$</li>";</script>', "style": "<style>.a > li { top: 0 } /* # */</style>"}[what], "hidden")
                self.add("\n")
        elif kind == "wiki":
            what = r.choice(["<!--\n== Gone ==\n* gone\n-->", "{{Box\n| a = b # c * d\n}}", "[[Category:Ridge]]", "<nowiki>== no == $x$ * no</nowiki>"])
            self.add(what, "hidden" if what[0] in "<{[" and "nowiki" not in what else None)
            self.add("\n\n")
        elif kind == "md":
            what = r.choice(["<!--\n## Gone\n- gone\n-->", "> " + self.point(), "| a | b |\n|---|---|\n| 1 | 2 |", self.hash_words()])
            self.add(what, "hidden" if what.startswith("<!--") else None)
            self.add("\n\n")
        else:
            self.add("% \\section{Gone}\n% \\item gone", "hidden")
            self.add("\n\n")


def labelled_pages(count: int = 700, seed: int = 20240229) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``count`` pages as (source, [(start, end, label)]); text carries no span."""
    rng = random.Random(seed)
    out = []
    for i in range(count):
        p = _Page(rng)
        kinds = rng.choice([["dom"], ["dom"], ["wiki"], ["md"], ["md"], ["latex"], ["dom", "wiki", "md", "latex"], ["dom", "md"], ["dom", "wiki"], ["none"]])
        if "dom" in kinds:
            p.add('<div class="mw-parser-output">\n')
        if kinds == ["latex"] and rng.random() < 0.7:
            p.add("\\documentclass{article}\n\\begin{document}\n\n", "hidden")
        for _ in range(rng.randint(2, 12)):
            kind = rng.choice(kinds)
            if kind == "none":
                p.prose("md", formulas=False)
                p.add("\n\n" + (p.hash_words() + "\n\n" if rng.random() < 0.5 else ""))
                continue
            part = rng.choices(["prose", "heading", "listing", "code", "display", "trap"], [5, 3, 2, 1.5, 1, 1])[0]
            if part == "prose":
                p.add("<p>" if kind == "dom" else "")
                p.prose(kind)
                p.add("</p>\n" if kind == "dom" else "\n\n")
            else:
                getattr(p, part)(kind)
            if len(kinds) > 1:
                p.add("\n")
        if "dom" in kinds:
            p.add("</div>")
        out.append(("".join(p.parts), p.spans))
    return out
