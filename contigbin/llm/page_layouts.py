"""Labelled web pages to train the block labeller: layouts drawn at random, words invented.

Every element of the article carries the attribute ``MARK`` = 1, everything around
it 0. Layouts name their regions by semantic elements, by classes and ids, or not at all; the article
stands in any of these, straight in the body, alone on the page, or in a table cell. Articles may hold lines that look like
menus or notices, and comments may read like prose, so that neither path nor words decide alone.
"""

from __future__ import annotations

import random

MARK = "data-main"

# Words that site makers use for classes and ids of regions, and phrases of menus, notices and forms
NAMES = {
    "main": "article content main post entry story body text page-content post-content entry-content article-body main-content story-body post-body blog-post content-area article-text markdown news-text prose single-post maincontent articleBody mw-content-text document primary read-content",
    "nav": "nav menu navbar navigation main-menu topnav site-nav nav-links breadcrumbs breadcrumb tabs pagination pager menu-item navbar-nav sub-menu nav-menu toc-nav skip-links links categories",
    "header": "header masthead site-header top topbar banner logo branding head-wrap page-header site-title tagline header-top",
    "footer": "footer site-footer bottom colophon copyright footer-links legal foot page-footer footer-widgets credits imprint",
    "side": "sidebar side aside widget widget-area right-col left-col rail sidebar-right recent-posts related popular trending tags tag-cloud secondary archive teaser recommended more-stories see-also related-posts",
    "ad": "ad ads advert advertisement sponsor sponsored promo banner-ad adsbygoogle ad-slot ad-container promotion affiliate outbrain partner advertising",
    "notice": "cookie cookie-notice cookie-banner consent gdpr notice alert modal popup overlay cookie-consent privacy-banner announcement message-bar disclaimer subscribe-wall paywall",
    "form": "form search search-form newsletter signup subscribe login contact-form search-box subscribe-form login-form poll feedback mailing-list",
    "comments": "comments comment comment-list respond discussion replies commentlist disqus comment-body user-comments responses reader-comments comments-area reviews reply",
    "share": "share social sharing share-buttons social-links share-bar follow-us",
}
NAMES = {kind: names.split() for kind, names in NAMES.items()}
NOISE = "container wrapper row inner clearfix col-md-8 col-4 box block section grid flex w-100 outer left right wrap panel module group item".split()
PHRASES = {
    "nav": "Home|About|About us|Contact|News|Sport|Help|FAQ|Archive|Products|Services|Blog|Login|Register|Next|Previous|Back to top|Startseite|Über uns|Kontakt|Accueil|À propos|Inicio|Contacto|Noticias|Read more|Skip to content|Menu|Close|Search|Categories|Sitemap",
    "notice": "We use cookies to improve your experience.|This site uses cookies.|Accept all cookies to continue.|By using this site you agree to our privacy policy.|Please enable JavaScript.|Diese Website verwendet Cookies.|Ce site utilise des cookies.|Este sitio usa cookies.|Accept|Reject|Manage preferences|You have read 3 of 5 free articles.|Breaking: click here for live updates.|Our office is closed today.",
    "ad": "Advertisement|Sponsored|Buy now and save 50%!|Limited offer.|Anzeige|Publicité|Publicidad|Order today, free shipping.|Ad|Try it free for 30 days!|Promoted content",
    "form": "Sign up for our newsletter|Your email address|Subscribe|Search|Name|Email|Password|Send|Log in|Forgot your password?|Leave a reply|Enter your comment|Post comment|I agree to the terms",
    "footer": "© 2021 Example Inc.|All rights reserved.|Privacy policy|Terms of use|Powered by Example|Impressum|Datenschutz|Mentions légales|Aviso legal|Contact us|Copyright 2019|Made with love",
    "side": "Related articles|Recent posts|Popular|Most read|Tags|Trending now|You may also like|Follow us|See also|About the author|Latest news",
    "comments": "Comments|3 comments|Reply|Report|Like|Posted 2 days ago|Anonymous says:|Leave a comment|Show more comments|Kommentare|Commentaires|Comentarios|Log in to comment",
    "share": "Share|Tweet|Facebook|Share on Facebook|Email this|Print|Pin it|WhatsApp",
}
PHRASES = {kind: text.split("|") for kind, text in PHRASES.items()}
SEMANTIC = {"nav": ["nav"], "header": ["header"], "footer": ["footer"], "side": ["aside"], "form": ["form"], "ad": ["aside", "ins"], "comments": ["section"], "main": ["article", "main"]}
SYLLABLES = "an re th ing on de la que ver ich en sch ta mo ri os ión ar ße né ou ka lo st er in ble nd wh ha to é ç ñ ü".split()


class Page:
    def __init__(self, rng: random.Random):
        self.rng, self.named, self.semantic = rng, rng.random() < 0.75, rng.random() < 0.6
        self.words = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(80)]

    def some(self, share: float) -> bool:
        return self.rng.random() < share

    def prose(self, low: int = 3, high: int = 60) -> str:
        words = self.rng.choices(self.words, k=self.rng.randint(low, high))
        for k in range(0, len(words), self.rng.randint(4, 12)):
            words[k] = words[k].capitalize()
            if k:
                words[k - 1] += self.rng.choice([".", ".", ",", "?", ":"])
        text = " ".join(words) + ("." if self.some(0.85) else "")
        if self.some(0.05):
            text = " ".join(w + self.rng.choice(["###", "***", "$$$", "&amp;"]) for w in words)
        return text

    def phrase(self, kind: str) -> str:
        own = PHRASES.get(kind, PHRASES["nav"])
        return self.rng.choice(own) if self.some(0.5) else self.prose(1, 4 if kind in ("nav", "share") else 14)

    def wrap(self, kind: str, inner: str, main: int, plain: bool = False) -> str:
        """An element of a region, named by its tag, its class or id, or neither."""
        tags = SEMANTIC.get(kind, [])
        semantic = bool(tags) and self.semantic and self.some(0.8)
        tag = self.rng.choice(tags) if semantic else self.rng.choice(["div", "div", "div", "section", "td" if plain else "div"])
        names = []
        if self.named and (not semantic or self.some(0.5)):
            names += self.rng.sample(NAMES[kind], self.rng.randint(1, 2))
        if self.some(0.3):
            names.append(self.rng.choice(NOISE))
        if self.some(0.1):
            names.append("css-" + "".join(self.rng.choices("abcdef0123456789", k=6)))
        attribute = f' {self.rng.choice(["class", "class", "id"])}="{" ".join(names)}"' if names else ""
        return f'<{tag}{attribute} {MARK}="{main}">{inner}</{tag}>'

    def links(self, kind: str, low: int = 2, high: int = 8) -> str:
        items = [f'<a href="/{k}">{self.phrase(kind)}</a>' for k in range(self.rng.randint(low, high))]
        form = self.rng.random()
        if form < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return " | ".join(items) if form < 0.8 else "".join(f"<div>{x}</div>" for x in items)

    def region(self, kind: str) -> str:
        r = self.rng
        if kind == "nav":
            inner = self.links("nav", 3, 9)
        elif kind == "header":
            inner = (f"<h1>{self.prose(1, 3)}</h1>" if self.some(0.4) else f'<a href="/">{self.prose(1, 3)}</a>') + (f"<p>{self.prose(2, 8)}</p>" if self.some(0.6) else "") + (self.links("nav") if self.some(0.4) else "")
        elif kind == "footer":
            inner = r.choice(["&copy; ", "© ", "Copyright ", ""]) + self.prose(1, 12) + r.choice([" &middot; ", " | ", "<br>", "</p><p>"]) + self.phrase("footer") + (self.links("footer") if self.some(0.5) else "")
            inner = f"<p>{inner}</p>" if self.some(0.5) else inner
        elif kind == "side":
            inner = "".join(f"<h3>{self.phrase('side')}</h3>" + (self.links("side") if self.some(0.7) else f"<p>{self.prose(4, 30)}</p>") for _ in range(r.randint(1, 3)))
        elif kind == "ad":
            inner = r.choice(["{}", "<p>{}</p>", '<a href="/x">{}</a>', "<span>{}</span>"]).format(self.phrase("ad") if self.some(0.6) else self.prose(4, 20))
        elif kind == "notice":
            inner = f"<p>{self.phrase('notice') if self.some(0.7) else self.prose(5, 20)}</p>" + (f'<a href="#">{self.phrase("notice")}</a>' if self.some(0.6) else "")
        elif kind == "form":
            inner = f"<label>{self.phrase('form')}</label><input type=text><p>{self.phrase('form')}</p><button>{self.phrase('form')}</button>"
            inner = inner if self.semantic else f"<form>{inner}</form>"
        elif kind == "comments":
            one = lambda: r.choice(["<li>{}</li>", "<div class=comment>{}</div>", "<div>{}</div>"]).format(f"<b>{self.prose(1, 2)}</b> {r.choice(['', 'says:', '<time>2 days ago</time>'])}<p>{self.prose(3, 40)}</p>" + (f'<a href="#">{self.phrase("comments")}</a>' if self.some(0.5) else ""))
            inner = (f"<h{r.choice([2, 3])}>{r.choice(PHRASES['comments']) if self.some(0.6) else self.prose(1, 8)}</h3>" if self.some(0.85) else "") + "".join(one() for _ in range(r.randint(1, 6)))
        else:
            inner = self.links("share", 2, 4)
        return self.wrap(kind, inner, 0)

    def article(self) -> str:
        r, parts = self.rng, []
        if self.some(0.85):
            parts.append(f"<h1>{self.prose(2, 10)}</h1>")
        form = r.choices(["<p>{}</p>", "<p><b>{}<br>", "<div>{}</div>", "<p>{}"], [6, 2, 1, 1])[0]
        for k in range(r.choice([1, 1, 2, 3, 4, 6, 9, 14, 20])):
            kind = r.random()
            if kind < 0.07:
                parts.append(f"<h{r.choice([2, 3])}>{self.prose(1, 7)}</h2>")
            elif kind < 0.11:
                parts.append("<ul>" + "".join(f"<li>{self.prose(2, 15)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.14:
                parts.append(f"<blockquote><p>{self.prose()}</p></blockquote>")
            elif kind < 0.16:
                parts.append("<table>" + "".join(f"<tr><td>{self.prose(1, 4)}</td><td>{self.prose(1, 4)}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>")
            elif kind < 0.18:
                parts.append(f"<figure><img src=x><figcaption>{self.prose(3, 12)}</figcaption></figure>")
            elif kind < 0.2:
                parts.append(f"<pre>{self.prose()}</pre>")
            elif kind < 0.24:
                odd = r.choice(["nav", "notice", "footer", "ad"])  # the article's own words look like something else
                parts.append(form.format(" | ".join(r.choices(PHRASES[odd], k=r.randint(1, 3)))))
            else:
                text = self.prose(1, 90) if self.some(0.9) else self.prose(1, 3)
                if self.some(0.15):
                    text += f' <a href="/y">{self.prose(1, 5)}</a> {self.prose(2, 9)}'
                parts.append(form.format(text))
            if k and self.some(0.06):
                parts.append(self.region(r.choice(["ad", "share", "form", "side"])))
        return "".join(parts)

    def html(self) -> str:
        r = self.rng
        around = lambda kind, share: [self.region(kind)] if self.some(share) else []
        top = around("notice", 0.25) + around("header", 0.5) + around("nav", 0.8) + around("form", 0.15) + around("ad", 0.45)
        r.shuffle(top)
        side, below = around("side", 0.4), around("share", 0.2) + around("comments", 0.35) + around("side", 0.15) + around("ad", 0.15) + around("form", 0.1)
        tail = around("nav", 0.1) + around("footer", 0.85) + around("notice", 0.2)
        inner, style, main = self.article(), r.random(), 0
        if self.some(0.05):
            top, side, below, tail = [], [], [], []  # the article is alone on the page
        if style < 0.1:
            article, main = inner, 1  # straight in the body or in the page's frame
        elif style < 0.2:
            article = f'<div {MARK}="1">{inner}</div>'  # nothing names it
        elif style < 0.32 and self.named:
            article = self.wrap("main", self.wrap("main", inner, 1), 0)
        else:
            article = self.wrap("main", inner, 1)
        if not main and self.some(0.12) and below:
            article = article[: article.rindex("</")] + "".join(below) + article[article.rindex("</") :]  # reader comments inside the article's element
            below = []
        middle = side + [article] + below if self.some(0.3) else [article, *below, *side]
        if self.some(0.1):
            rows = ["".join(top), f'</td><td {MARK}="{main}">'.join(x for x in ("".join(side), article, "".join(below)) if x)] if self.some(0.5) else ["".join(top) + f'</td><td {MARK}="{main}">' + "".join(middle)]
            cells = "".join(f'<tr><td {MARK}="{main}">{x}</td></tr>' for x in [*rows, *(tail if self.some(0.5) else [])] if x)
            body = f"<table>{cells}</table>" + ("" if tail and tail[-1] in cells else "".join(tail))
        elif self.some(0.5):
            body = "".join(top) + f'<div class="{r.choice([*NOISE, "page", "site", "content", "main"])}" {MARK}="{main}">' + "".join(middle) + "</div>" + "".join(tail)
        else:
            body = "".join(top + middle + tail)
        return f"<!DOCTYPE html><html><head><title>{self.prose(2, 8)}</title><script>x('<p>')</script></head><body {MARK}={main}>{body}" + ("</body></html>" if self.some(0.9) else "")


def pages(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return [Page(rng).html() for _ in range(n)]
