"""Reader for the search box's AND / OR / NOT expressions.

Operators are upper case (or ``&&``, ``||``, ``!``); NOT binds tighter than AND,
AND tighter than OR; two operands side by side mean AND; NOT is binary and means
"and not". The result is a nested tuple ``(op, left, right)`` over leaf strings.
"""

import re

# --- fixed values: pieces of an expression, aliases and binding strength ---
PIECE = re.compile(r'\s*(?:([()])|"([^"]*)"|(\b(?:AND|OR|NOT)\b|&&|\|\||!)|([^\s()"]+))')
ALIASES = {"&&": "AND", "||": "OR", "!": "NOT"}
STRENGTH = {"OR": 1, "AND": 2, "NOT": 3}
UNSEARCHABLE = re.compile(r'["*^:{}()\[\]]')


class ExpressionError(ValueError):
    """The text is not a complete expression."""


def _pieces(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = PIECE.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected character at position {at + 1}")
        paren, phrase, op, term = m.groups()
        if paren:
            out.append((paren, paren))
        elif op:
            out.append(("op", ALIASES.get(op, op)))
        else:
            leaf = " ".join(UNSEARCHABLE.sub(" ", phrase if term is None else term).split())
            if not leaf:
                raise ExpressionError("a term has no searchable characters")
            out.append(("leaf", leaf))
        at = m.end()
    return out


def read(text: str):
    """Nested tuple of the expression; ``None`` for blank input."""
    pieces = _pieces(text or "")
    if not pieces:
        return None
    pieces.reverse()  # a stack: the next piece is at the end
    tree = _operand_then_operators(pieces, 1)
    if pieces:
        raise ExpressionError("unmatched ')'")
    return tree


def _operand_then_operators(pieces, weakest):
    kind, value = pieces.pop() if pieces else ("end", "")
    if kind == "(":
        left = _operand_then_operators(pieces, 1)
        if not pieces or pieces.pop()[0] != ")":
            raise ExpressionError("unclosed parenthesis")
    elif kind == "leaf":
        left = value
    else:
        raise ExpressionError("an operator needs a term on both sides")
    while pieces and pieces[-1][0] != ")":
        op = pieces[-1][1] if pieces[-1][0] == "op" else "AND"
        if STRENGTH[op] < weakest:
            break
        if pieces[-1][0] == "op":
            pieces.pop()
        left = (op, left, _operand_then_operators(pieces, STRENGTH[op] + 1))
    return left


def leaves(tree) -> list[str]:
    if isinstance(tree, str):
        return [tree]
    return leaves(tree[1]) + leaves(tree[2])
