"""The views as named SQL, composed into statements."""

from __future__ import annotations

_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: tuple[str, ...], body: str) -> None:
    _CTES[name] = (needs, body)


def with_ctes(names: tuple[str, ...], body: str) -> str:
    """A statement with the named views (and what they need) as common table expressions."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for need in _CTES[n][0]:
            visit(need)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({_CTES[n][1]})" for n in order) + "\n" + body
