"""Small documents that the tests share."""

from docloom.plans.rules import minimal, page

__all__ = ["codes", "minimal", "page"]


def codes(diagnostics, doc):
    return {(r["code"], r["path"]) for r in diagnostics if r["doc_id"] == doc}
