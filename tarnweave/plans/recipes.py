"""Ready rule sets for common kinds of pages; each gives one item per container element."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.extract import value_of
from ..functions.htmldom import Document
from ..operators.pages import page_rows


@dataclass(frozen=True)
class Recipe:
    """fields: name -> (selector within the container, what to take); all=True fields give every match, joined by |."""

    container: str
    fields: dict[str, tuple[str, str]]
    many: tuple[str, ...] = ()


RECIPES = {
    "quotes": Recipe(".quote", {"quote": (".text", ""), "by": (".author", ""), "tags": (".tag", "")}, ("tags",)),
    "products": Recipe("article.product_pod, .product", {"name": ("h3 a, h2", ""), "price": (".price_color, .price", ""), "link": ("a", "href"), "rating": (".star-rating, .rating", "class")}),
    "stories": Recipe("tr.athing", {"rank": (".rank", ""), "title": (".titleline > a", ""), "link": (".titleline > a", "href"), "site": (".sitestr", "")}),
    "repositories": Recipe("article.Box-row, li.repo", {"name": ("h2 a, h3 a", ""), "link": ("h2 a, h3 a", "href"), "about": ("p", ""), "language": ("[itemprop=programmingLanguage]", "")}),
    "articles": Recipe("article", {"title": ("h1, h2", ""), "by": (".author, .byline", ""), "date": ("time", "datetime"), "lead": ("p", "")}),
    "encyclopedia": Recipe("body", {"title": ("h1", ""), "lead": ("p:not(.empty)", ""), "sections": ("h2", ""), "categories": (".catlinks li", "")}, ("sections", "categories")),
}


def run_recipe(pages: DataFrame, recipe: Recipe, keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(position, item map) per container that yields a field; fields without a match are absent."""

    def one(url: str, raw: str, doc: Document) -> Iterator[tuple]:
        k = 0
        for box in doc.select(recipe.container):
            item = {}
            for name, (css, take) in recipe.fields.items():
                got = (v for v in (value_of(n, take) for n in doc.select(css, box)) if v)
                if v := "|".join(got) if name in recipe.many else next(got, ""):
                    item[name] = v
            if item:
                yield k, item
                k += 1

    return page_rows(pages, "position int, item map<string,string>", one, keep)
