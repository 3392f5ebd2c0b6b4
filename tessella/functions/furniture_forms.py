"""Forms of lines of pages."""

# Forms of lines.
FENCE = r"^ {0,3}(`{3,}|~{3,})"
RULE = r"^\s*((-\s*){3,}|(\*\s*){3,}|(_\s*){3,})$"
MARKER = r"(?i)^\s*(---\s*end\s+of\s+page\s*=\s*\d+\s*---|<!--\s*page(break)?(\s*[:=#-]?\s*\d+)?\s*-->|\[\[?\s*page\s+\d+\s*\]?\]|\\pagebreak|\f)\s*$"
DELIMITER = r"^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\s*$"
STRUCTURE = r"^\s*(>\s?|[-+*]\s+|\d{1,4}[.)]\s+|!\[|\[[^\]]+\]:)"
HEADING = r"^\s{0,3}#{1,6}\s+"
PAGE_LABEL = r"(?i)^\s*([#>*_`~-]+\s*)*(page|pg\.?|p\.)\s*[:#-]?\s*\d{1,6}(\s*(of|/|\\)\s*\d{1,6})?(\s*[#>*_`~-]+)*\s*$"
ARABIC = r"(?i)^\s*(?:[*_`#~-]+\s*)*([0-9]{1,6})(?:\s*(?:of|/|\\)\s*([0-9]{1,6}))?(?:\s*[*_`#~-]+)*\s*$"
ROMAN = r"(?i)^\s*(?:[*_`#~-]+\s*)*([ivxlcdm]{2,8})(?:\s*[*_`#~-]+)*\s*$"
SIZES = r"[\[(]?\s*\d+(?:\.\d+)?\s*[x×]\s*\d+(?:\.\d+)?\s*[\])]?"
ARROW = r"(?:={2,}>|<={1,2})?"
PLACEHOLDER = rf"(?i)^\s*(?:[-*_]\s*)*{ARROW}\s*(?:picture|image|figure|graphic|vector(?:\s+graphic)?|drawing)\b(?:\s*[:#-]?\s*{SIZES})?(?:\s+(?:was\s+)?(?:intentionally\s+)?omitted)?\s*{ARROW}\s*$"
PLACEHOLDER_SIGN = rf"(?i)omitted|==>|<==|{SIZES}"
SIZES_ALONE = rf"^\s*{ARROW}\s*\[\s*\d+(?:\.\d+)?\s*[x×]\s*\d+(?:\.\d+)?\s*\]\s*{ARROW}\s*$"
CONTACT = r"(?i)https?://|www\.|\b[\w.+-]+@[\w.-]+\.[a-z]{2,}\b"
NUMBER_BEHIND = r"(?i)(?:(?:page|pg\.?)\s*[:#-]?\s*\d{1,6}(?:\s*(?:of|/)\s*\d{1,6})?|(?<!\d)\d{1,4}\s*(?:of|/)\s*\d{1,6})\s*$"
NUMBER_BEHIND_MARK = r"([|:–—-])\s*\d{1,4}\s*$"
WORD = r"[\p{L}\p{N}]+(?:[’'\-][\p{L}\p{N}]+)*"
ROMAN_DIGITS = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
