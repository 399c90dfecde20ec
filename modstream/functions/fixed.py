"""Values that must be as they are for results to agree with other moderation tools: fixed values, plainly listed."""

# Digits stand for letters, 0 to 9.
DIGIT_LETTERS = "oizeasgtbg"

# Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = {
    "а": "a", "А": "a", "е": "e", "Е": "e", "о": "o", "О": "o", "р": "p", "Р": "p", "с": "c", "С": "c", "у": "y", "У": "y",
    "х": "x", "Х": "x", "Α": "a", "Β": "b", "Ε": "e", "Ο": "o", "Ρ": "p",
}

# Invisible characters that are dropped besides format and control characters.
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u180e"

# Commands that a user under a global mute may not use.
TALKING_COMMANDS = ("msg", "tell", "w", "whisper", "r", "reply", "mail", "me", "say", "nick", "nickname", "tags", "rename")

# Endings that mark a domain, and words that stand for a dot.
BLOCKED_ENDINGS = ("com", "net", "org", "info", "biz", "pro", "site", "online", "club", "vip", "top", "xyz", "link", "click", "shop", "store")
DOT_WORDS = ("dot", "point", "punto")

# Categories that are always logged, and those logged only while masking is off.
LOGGED = ("IP Split", "Anti-Domain", "Anti-Ip", "Anti-Flood", "Evasion", "Text usage (Zalgo/Unicode)", "Injection")
LOGGED_UNMASKED = ("(WordBlock)", "Filter")

# Markup that is allowed to stay: colours and decorations.
SAFE_TAGS = (
    "black", "dark_blue", "dark_green", "dark_aqua", "dark_red", "dark_purple", "gold", "gray", "grey", "dark_gray", "dark_grey",
    "blue", "green", "aqua", "red", "light_purple", "yellow", "white", "color", "colour", "c", "bold", "b", "italic", "em", "i",
    "underlined", "u", "strikethrough", "st", "obfuscated", "obf", "rainbow", "gradient",
)
