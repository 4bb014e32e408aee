"""Text patterns shared by the extraction and context operators.

All of them run in Spark's regular-expression functions.  Line ends are ``\\n`` only
(``(?d)``), and every repetition over a group is possessive, so that matching stays
iterative on long texts.
"""

# White space inside a line, and white space at the end of a text.
INLINE_SPACE = r"[ \t\f\r]"
TRAILING_SPACE = (
    " \t\n\x0b\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Heading lines, and the lines that open and close a YAML fence.
HEADING = rf"#{{1,6}}{INLINE_SPACE}"
FENCE_OPEN = rf"```ya?ml{INLINE_SPACE}*+"
FENCE_CLOSE = rf"```{INLINE_SPACE}*+"

# A whole fence; an unterminated one runs to the end of the text.  Group 1 is the block text, taken by lines and not by characters.
FENCE = (
    rf"(?msd)^{FENCE_OPEN}(?:\n((?:(?!{FENCE_CLOSE}$)[^\n]*+(?:\n(?!{FENCE_CLOSE}$|\z)[^\n]*+)*+)?+)\n?+"
    rf"(?:^{FENCE_CLOSE}$|\z)|\z)"
)

# Consecutive tokens that cover a text: one fence with its line ends, or a run of other lines.
FENCE_OR_RUN = (
    rf"(?msd){FENCE_OPEN}(?:\n.*?(?:^{FENCE_CLOSE}(?:\n|\z)|\z)|\z)"
    rf"|(?:(?!{FENCE_OPEN}$)(?:[^\n]*+\n|[^\n]++\z))++"
)
BEFORE_HEADING = rf"(?md)^(?={HEADING})"
STARTS_WITH_FENCE = rf"\A{FENCE_OPEN}(?:\n|\z)"
HEADING_MARKS = rf"\A(#{{1,6}}){INLINE_SPACE}"

# A fence with the heading directly before it (only blank lines between).
# Group 1 is the heading, group 2 the fence.
HEADED_FENCE = (
    rf"(?msd)(?:^({HEADING}[^\n]*+)\n(?:(?U:[\s&&[^\n]])*+\n)*+)?"
    rf"^({FENCE_OPEN}(?:\n.*?(?:^{FENCE_CLOSE}$|\z)|\z))"
)

# Leading ``key: value`` lines of a text that has no frontmatter.
HEADER_BLOCK = rf"\A((?:[\w. -]++{INLINE_SPACE}*+:[^\n]*+(?:\n|\z))++)"
BLANK_FIRST_LINE = r"(?U)\A[\s&&[^\n]]*+(?:\n|\z)"
