"""Trains the block labeller on pages that it makes up: ``python -m quarry.llm.train_html``.

Every page is drawn from a random layout (containers, class names, menus, notices, adverts, forms,
side columns, comments, related links, footers in many spellings) around random prose, so that the
labeller has to learn from paths, words and neighbours. Training is plain numpy: back-propagation
through time and Adam.
"""

from __future__ import annotations

import random

import numpy as np

from .htmlblocks import HIDDEN, INPUT, WEIGHTS, Block, features, leaf_blocks, reversed_within, sigmoid

MARK = "\x01"  # in front of the text of blocks to keep

#: Words of page furniture.
MENU = "home about contact news blog archive login register search menu products services help faq sitemap privacy terms subscribe rss shop account profile settings".split()
FOOT = ["© 2021 Example Ltd. All rights reserved.", "Privacy Policy", "Terms of Use", "Contact us", "Imprint", "Copyright 2019", "Powered by", "Follow us on", "© {w} · {s}", "© {w}", "{s}"]
NOTICE = ["We use cookies to improve your experience.", "This site uses cookies. Accept all cookies?", "By continuing you agree to our privacy policy.", "Please enable JavaScript.", "Subscribe to our newsletter for updates!", "Your browser is out of date.", "{s}"]
ADVERT = ["Advertisement", "Sponsored content", "Buy now and save 50%!", "Special offer: click here", "{s}", "{s} {s}"]
COMMENT_HEAD = ["Comments", "3 comments", "Reader comments", "Leave a reply", "Discussion"]
SIDE_HEAD = ["Related articles", "Popular posts", "Recent posts", "Categories", "Tags", "You may also like", "Most read", "Share this", "About the author", "Archives"]
CLASSES = {
    "nav": ["nav", "menu", "navbar", "navigation", "topnav", "main-menu", "breadcrumb", "breadcrumbs", "links"],
    "header": ["header", "site-header", "masthead", "top", "banner", "branding", "page-header"],
    "footer": ["footer", "site-footer", "foot", "bottom", "copyright", "legal", "colophon"],
    "aside": ["sidebar", "side", "widget", "related", "aside", "rail", "recommended", "trending", "popular", "right-column", "secondary"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "ad-slot", "adsbox", "sponsor"],
    "notice": ["cookie", "cookie-notice", "notice", "consent", "gdpr", "alert", "popup", "newsletter", "subscribe", "overlay", "modal", "banner"],
    "comments": ["comments", "comment-list", "comment", "discussion", "responses", "replies", "disqus", "reader-comments", "comments-area"],
    "share": ["share", "social", "share-buttons", "social-links", "sharing"],
    "form": ["form", "search-form", "login", "signup", "contact-form", "subscribe-form"],
    "main": ["content", "post", "entry", "article", "story", "article-body", "post-content", "entry-content", "main-content", "page-content", "text", "body-text"],
    "none": ["wrapper", "container", "row", "col", "inner", "page", "site", "layout", "grid", "box", "wrap"],
}


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        r = self.r
        self.syllables = ["".join(r.choice("bcdfghlmnprstvwéèäöñaeiou") for _ in range(r.randrange(1, 4))) for _ in range(60)]

    def word(self) -> str:
        return "".join(self.r.choice(self.syllables) for _ in range(self.r.randrange(1, 5)))

    def sentence(self, least: int = 3, most: int = 22) -> str:
        r = self.r
        words = [self.word() + ("," if r.random() < 0.08 else "") for _ in range(r.randrange(least, most))]
        if r.random() < 0.06:
            words = [w + r.choice(["***", "%%%", "&amp;&amp;", "$$$", "###", " |"]) for w in words]
        return (" ".join(words)).capitalize() + r.choice(["."] * 9 + ["?", "!", ""])

    def prose(self, most: int = 9) -> str:
        odd = self.r.random()
        if odd < 0.05:
            return " | ".join(self.word() for _ in range(self.r.randrange(2, 30)))
        if odd < 0.1:
            return " ".join([self.word()] * self.r.randrange(2, 40)) + " " + self.sentence()
        if odd < 0.14:
            return " ".join(self.sentence().upper() + "!!" for _ in range(self.r.randrange(1, most)))
        if odd < 0.18:
            return f"{self.sentence()} {self.r.randrange(10**9)} {self.word()}@{self.word()}.com {self.sentence()}"
        return " ".join(self.sentence() for _ in range(self.r.randrange(1, most)))

    def fill(self, options: list[str]) -> str:
        return self.r.choice(options).format(w=self.word(), s=self.sentence())

    def named(self, kind: str, tag: str | None = None, chance: float = 0.85) -> tuple[str, str]:
        r = self.r
        tag = tag or r.choice(["div", "div", "section", "ul"] if kind == "nav" else ["div", "div", "section"])
        if r.random() > chance:
            return f"<{tag}>", f"</{tag}>"
        name = r.choice(CLASSES[kind])
        if r.random() < 0.25:
            name += " " + r.choice([*CLASSES["none"], self.word()])
        return f'<{tag} {r.choice(["class", "class", "class", "id"])}="{name}">', f"</{tag}>"

    def menu(self, n: int | None = None) -> str:
        r = self.r
        items = [r.choice(MENU).capitalize() if r.random() < 0.4 else self.word() for _ in range(n or r.randrange(3, 10))]
        if r.random() < 0.75:
            return "<ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in items) + "</ul>"
        return " | ".join(f'<a href="/{w}">{w}</a>' for w in items)

    def furniture(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            a, b = ("<nav>", "</nav>") if r.random() < 0.6 else self.named("nav", chance=1)
            return a + self.menu() + b
        if kind == "header":
            a, b = ("<header>", "</header>") if r.random() < 0.6 else self.named("header", chance=1)
            inside = r.choice([f"<div>{self.word()}</div>", f"<h2>{self.sentence(1, 5)}</h2>", f"<p>{self.sentence()}</p>", f"<h1>{self.word()}</h1>", self.menu(), self.word()])
            return a + inside + (self.menu() if r.random() < 0.4 else "") + b
        if kind == "footer":
            a, b = ("<footer>", "</footer>") if r.random() < 0.7 else self.named("footer", chance=1)
            return a + "".join(r.choice(["<p>{}</p>", "<div>{}</div>", "{}"]).format(self.fill(FOOT)) for _ in range(r.randrange(1, 4))) + (self.menu() if r.random() < 0.3 else "") + b
        if kind == "aside":
            a, b = ("<aside>", "</aside>") if r.random() < 0.5 else self.named("aside", chance=1)
            body = r.choice([self.menu(), self.plain(""), f"<p>{self.prose(4)}</p>", f"<ul><li>{self.sentence()}</li><li>{self.sentence()}</li></ul>", f'<p><a href="#">{self.sentence()}</a></p>'])
            return a + (f"<h3>{r.choice(SIDE_HEAD) if r.random() < 0.6 else self.sentence(1, 5)}</h3>" if r.random() < 0.7 else "") + body + b
        if kind == "ad":
            a, b = self.named("ad", chance=1)
            return a + r.choice(["{}", "<p>{}</p>", '<a href="#">{}</a>']).format(self.fill(ADVERT)) + b
        if kind == "notice":
            a, b = self.named("notice", chance=1)
            return a + r.choice(["{}", "<p>{}</p>"]).format(self.fill(NOTICE)) + ("<button>OK</button>" if r.random() < 0.4 else "") + b
        if kind == "share":
            a, b = self.named("share", chance=1)
            return a + r.choice(["Share on Facebook", "Tweet", self.word(), f"<p>{self.sentence(2, 6)}</p>", self.menu(3)]) + b
        if kind == "form":
            a, b = "<form action='#'>", "</form>"
            if r.random() < 0.3:
                c, d = self.named("form", chance=1)
                a, b = c + a, b + d
            return a + r.choice(["<label>{}</label><input type=text>", "<p>{}</p><input name=q>", "<legend>{}</legend><input>", "<div>{}</div>"]).format(self.sentence(1, 8)) + b
        a, b = self.named("comments", r.choice(["div", "section", "ol", "ul", "aside"]), chance=1)
        one = "<li>{}</li>" if a.startswith(("<ol", "<ul")) else r.choice(['<div class="comment"><p>{}</p></div>', "<p>{}</p>", "<div>{}</div>", '<article class="comment"><p>{}</p></article>'])
        return a + (f"<h{r.choice('234')}>{r.choice(COMMENT_HEAD)}</h3>" if r.random() < 0.6 else "") + "".join(one.format((f"<b>{self.word()}</b> " if r.random() < 0.4 else "") + self.prose(5)) for _ in range(r.randrange(1, 7))) + b

    def figure(self) -> str:
        """A number as tables hold it."""
        r = self.r
        return r.choice(["{}", "{}%", "{}.5", "-{}", "{},000", "20{}", "{} kg", "$ {}", "n/a"]).format(r.randrange(0, 10 ** r.randrange(1, 5)))

    def cell(self) -> str:
        odd = self.r.random()
        return self.figure() if odd < 0.4 else self.word() if odd < 0.75 else self.sentence(1, 5) if odd < 0.95 else "-"

    def plain(self, mark: str) -> str:
        """Blocks of an article that are no prose: tables, definitions, captions, code; ``mark`` opens each of their texts."""
        r = self.r
        kind = r.random()
        if kind < 0.5:
            columns = r.randrange(1, 6)
            row = lambda tag: "<tr>" + "".join(f"<{tag}>{mark}{self.cell()}</{tag}>" for _ in range(columns)) + "</tr>"
            caption = f"<caption>{mark}{self.sentence(1, 6)}</caption>" if r.random() < 0.2 else ""
            top = row("th") if r.random() < 0.6 else ""
            rows = "".join(row("td") for _ in range(r.randrange(1, 7)))
            if r.random() < 0.4:
                top, rows = f"<thead>{top}</thead>" if top else "", f"<tbody>{rows}</tbody>"
            return f"<table>{caption}{top}{rows}</table>"
        if kind < 0.7:
            return "<dl>" + "".join(f"<dt>{mark}{self.sentence(1, 3)}</dt><dd>{mark}{self.sentence()}</dd>" for _ in range(r.randrange(1, 6))) + "</dl>"
        if kind < 0.8:
            return f"<figure><img src='{self.word()}.png'><figcaption>{mark}{self.sentence(1, 9)}</figcaption></figure>"
        if kind < 0.9:
            lines = [f"{self.word()}({self.word()}, {self.figure()}){r.choice([';', ':', ' {', ''])}" for _ in range(r.randrange(1, 9))]
            text = mark + chr(10).join(lines)
            return r.choice([f"<pre><code>{text}</code></pre>", f"<pre>{text}</pre>", f'<div class="code"><pre>{text}</pre></div>'])
        return "<ol>" + "".join(f"<li>{mark}{self.cell()}</li>" for _ in range(r.randrange(1, 7))) + "</ol>"

    def some(self, kinds: list[str], most: int) -> str:
        return "".join(self.furniture(self.r.choice(kinds)) for _ in range(self.r.randrange(0, most + 1)))

    def main(self) -> str:
        r = self.r
        out = []
        loose = r.random() < 0.5
        if r.random() < 0.9:
            out.append(f"<h1>{MARK}{self.sentence(1, 9)}</h1>")
        for k in range(r.randrange(1, 26) if r.random() < 0.85 else r.randrange(20, 70)):
            kind = r.random()
            text = MARK + (self.prose() if r.random() < 0.8 else self.sentence(1, 5))
            if k == 0 and r.random() < 0.5:
                out.append(f"<p><b>{text}<br>" if loose else f"<p><b>{text}</b></p>")
            elif kind < 0.76:
                if r.random() < 0.1:
                    text += f' <a href="#">{self.word()}</a> {self.word()}'
                out.append(f"<p>{'<b>' if r.random() < 0.05 else ''}{text}" + ("" if loose and r.random() < 0.3 else "</p>") + ("<br>" if r.random() < 0.05 else ""))
            elif kind < 0.84:
                out.append(f"<h{r.choice('23')}>{MARK}{self.sentence(1, 7)}</h2>")
            elif kind < 0.89:
                out.append("<ul>" + "".join(f"<li>{MARK}{self.sentence()}</li>" for _ in range(r.randrange(1, 5))) + "</ul>")
            elif kind < 0.91:
                out.append(f"<blockquote>{text}</blockquote>")
            elif kind < 0.92:
                out.append(f"<pre>{text}</pre>")
            else:
                out.append(self.plain(MARK))
            if r.random() < 0.04:
                out.append(self.furniture(r.choice(["ad", "share", "aside", "notice", "form"])))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        head = f"<!DOCTYPE html><html><head><title>{self.sentence()}</title><style>p{{}}</style></head><body>"
        before = self.some(["nav", "header", "nav", "notice", "ad", "ad", "form", "aside"], 4)
        after = self.some(["comments", "aside", "ad", "share", "form", "footer", "nav", "notice"], 4) + (self.furniture("footer") if r.random() < 0.7 else "")
        kind = r.random()
        if kind < 0.5:
            a, b = r.choice(["<article>", '<article class="post">', '<article id="main">']), "</article>"
        elif kind < 0.65:
            a, b = "<main>", "</main>"
        elif kind < 0.95:
            a, b = self.named("main", chance=1)
        else:
            a, b = "", ""
        inside = self.some(["share", "ad", "comments", "form", "aside"], 1) if r.random() < 0.3 else ""
        body = a + self.main() + inside + b
        if r.random() < 0.35:
            c, d = self.named("none", chance=1)
            body = c + body + d
        if r.random() < 0.15:
            body = f"<main>{body}</main>"
        if r.random() < 0.25:
            c, d = self.named("none", chance=1)
            return head + c + before + body + after + d + "</body></html>"
        return head + before + body + after + "</body></html>"


def example(seed: int) -> tuple[np.ndarray, np.ndarray]:
    blocks = leaf_blocks(Maker(seed).page())
    y = np.array([MARK in b.text for b in blocks], dtype=np.float32)
    return features([Block(b.element, b.text.replace(MARK, "") or "-", b.linked) for b in blocks]), y


def _forward(x, w, u, b):
    n, steps, _ = x.shape
    h = np.zeros((n, HIDDEN), np.float32)
    c = h.copy()
    hs, keep = np.zeros((n, steps, HIDDEN), np.float32), []
    xw = x @ w + b
    for t in range(steps):
        z = xw[:, t] + h @ u
        i, f, o = (sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        before = (h, c)
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        keep.append((i, f, o, g, tc, *before))
        hs[:, t] = h
    return hs, keep


def _backward(x, w, u, keep, dhs):
    dw, du, db = np.zeros_like(w), np.zeros_like(u), np.zeros(4 * HIDDEN, np.float32)
    dh = np.zeros_like(dhs[:, 0])
    dc = dh.copy()
    for t in reversed(range(x.shape[1])):
        i, f, o, g, tc, hp, cp = keep[t]
        dh = dh + dhs[:, t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * cp * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dw += x[:, t].T @ dz
        du += hp.T @ dz
        db += dz.sum(0)
        dh, dc = dz @ u.T, dc * f
    return dw, du, db


def train(pages: int = 20000, epochs: int = 6, batch: int = 32, rate: float = 4e-3, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    data = [e for e in map(example, range(pages)) if len(e[1])]
    data = [(x[:160], y[:160]) for x, y in data]
    m = {}
    for d in "01":
        m[f"w{d}"] = rng.normal(0, 0.1, (INPUT, 4 * HIDDEN)).astype(np.float32)
        m[f"u{d}"] = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        m[f"b{d}"] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)].astype(np.float32)
    m["v"], m["c"] = rng.normal(0, 0.1, 2 * HIDDEN + INPUT).astype(np.float32), np.zeros(1, np.float32)
    first, second, step = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
    for epoch in range(epochs):
        order = sorted(rng.permutation(len(data)), key=lambda k: len(data[k][1]) // 8)
        groups = [order[k : k + batch] for k in range(0, len(order), batch)]
        rng.shuffle(groups)
        loss_sum = wrong = count = 0.0
        for group in groups:
            sizes = np.array([len(data[k][1]) for k in group])
            x = np.zeros((len(group), sizes.max(), INPUT), np.float32)
            y, on = np.zeros(x.shape[:2], np.float32), np.zeros(x.shape[:2], np.float32)
            for j, k in enumerate(group):
                x[j, : sizes[j]], y[j, : sizes[j]], on[j, : sizes[j]] = *data[k], 1
            xr = reversed_within(x, sizes)
            h0, k0 = _forward(x, m["w0"], m["u0"], m["b0"])
            h1r, k1 = _forward(xr, m["w1"], m["u1"], m["b1"])
            every = np.concatenate([h0, reversed_within(h1r, sizes), x], axis=2)
            p = sigmoid(every @ m["v"] + m["c"])
            n = on.sum()
            loss_sum += -(on * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum()
            wrong += (on * ((p >= 0.5) != (y > 0.5))).sum()
            count += n
            dz = on * (p - y) / n
            g = {"v": np.einsum("ij,ijk->k", dz, every) + 1e-4 * m["v"], "c": dz.sum(keepdims=True)[0]}
            dh = dz[:, :, None] * m["v"][None, None, : 2 * HIDDEN]
            g["w0"], g["u0"], g["b0"] = _backward(x, m["w0"], m["u0"], k0, dh[:, :, :HIDDEN])
            g["w1"], g["u1"], g["b1"] = _backward(xr, m["w1"], m["u1"], k1, reversed_within(dh[:, :, HIDDEN:], sizes))
            norm = sum(float((v * v).sum()) for v in g.values()) ** 0.5
            step += 1
            r = rate * (0.5 ** (epoch * 0.8)) * min(1, step / 50)
            for key in m:
                v = g[key] * min(1.0, 2.0 / (norm + 1e-9))
                first[key] = 0.9 * first[key] + 0.1 * v
                second[key] = 0.999 * second[key] + 0.001 * v * v
                m[key] = (m[key] - r * (first[key] / (1 - 0.9**step)) / (np.sqrt(second[key] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        print(f"epoch {epoch}: loss {loss_sum / count:.4f}, wrong {wrong / count:.4f}", flush=True)
    return m


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float16) for k, v in train().items()})
