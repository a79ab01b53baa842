"""Word lists and patterns that decide results, as Java regular expressions.

Fixed values: each list has to read exactly like this for the cleaned text, the categories
and the labels to come out right. Matching is case-insensitive throughout.
"""

from __future__ import annotations


def any_of(alternatives) -> str:
    return "(?:" + "|".join(alternatives) + ")"


# Tags whose presence makes a body HTML (an address in angle brackets does not).
HTML_TAGS = (
    "html", "head", "body", "div", "span", "p", "br", "table", "tr", "td", "th",
    r"a\s", r"img\s", "h[1-6]", "ul", "ol", "li", "strong", "em", "b", "i", "style",
    "script", "meta", "link", "footer", "header", "blockquote", "center", "font",
    "!DOCTYPE", "!--",
)
HTML = rf"(?iU)<{any_of(HTML_TAGS)}[^>]*>"

# Weekday and month names that open "On ... wrote:".
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

# Lines that open a quoted earlier message.
REPLY_HEADERS = (
    rf"On\s+{any_of(WEEKDAYS)}.*\bwrote:\s*",
    r"On\s+\d.*\bwrote:\s*",
    rf"On\s+{any_of(MONTHS)}\b.*\bwrote:\s*",
    r"-{2,}\s*(?:Original|Forwarded)\s+[Mm]essage\s*-{2,}\s*",
    r"From:\s+.+\n\s*Sent:\s+.+\n\s*To:\s+.+\n\s*Subject:\s+.+",
)
REPLY_HEADER = rf"(?imUd)^{any_of(REPLY_HEADERS)}$"
QUOTED_LINE = r"(?U)^\s*>"

# Lines that open a signature.
SIGNATURE_LINES = (
    r"--\s*", r"---+\s*", r"_{3,}\s*",
    r"Sent from (?:my )?\w.*", r"Sent via\b.*", r"Get Outlook for\b.*",
    r"Sent from Mail for\b.*",
    r"(?:Best|Kind|Warm)\s+regards?\s*[,.]?\s*",
    r"(?:Thanks|Thank you|Cheers|Regards|Sincerely|Yours truly)\s*[,.]?\s*",
    r"(?:With appreciation|All the best|Talk soon)\s*[,.]?\s*",
)
SIGNATURE = rf"(?iUd)^{any_of(SIGNATURE_LINES)}$"

# Confidentiality wording that also opens a signature.
CONFIDENTIALITY_PHRASES = (
    r"this\s+(?:email|message|communication)\s+is\s+(?:intended|confidential)",
    r"confidentiality\s+notice",
    r"privileged\s+and\s+confidential",
    r"if\s+you\s+(?:are\s+not|have\s+received)\s+this\s+(?:email|message)\s+in\s+error",
    r"please\s+notify\s+the\s+sender\s+immediately",
    r"unauthorized\s+(?:use|disclosure|review|distribution)",
)
CONFIDENTIALITY = rf"(?iU){any_of(CONFIDENTIALITY_PHRASES)}"

# List-mail boilerplate whose whole line is blanked.
BOILERPLATE_PHRASES = (
    r"unsubscribe", r"opt[\s-]?out", r"email\s+preferences", r"manage\s+subscriptions?",
    r"update\s+(?:your\s+)?preferences", r"no\s+longer\s+wish\s+to\s+receive",
    r"stop\s+receiving", r"view\s+(?:in|this\s+email\s+in)\s+(?:your\s+)?browser",
    r"add\s+us\s+to\s+your\s+address\s+book",
    r"problems?\s+(?:viewing|displaying)\s+this\s+email",
    r"click\s+here\s+to\s+view\s+this\s+message",
)
BOILERPLATE_LINE = rf"(?imUd)^.*{any_of(BOILERPLATE_PHRASES)}.*$"

# Image URLs and inline styles of tracking pixels.
TRACKER_URLS = (
    "track", "pixel", "beacon", r"open\.", r"\.gif\?", "mailtrack", r"t\.co/", r"click\.",
    r"/o\.gif", "spacer", "transparent", r"/t\?", r"wf\.gif",
)
TRACKER_URL = any_of(TRACKER_URLS)
TINY_STYLE = r"(?:width|height)\s*:\s*[01]px|display\s*:\s*none"

# Parts of click-tracking link targets; such a link keeps only its text.
LINK_TRACKERS = (
    "click.", "track.", "trk.", "redirect.", "go.", "link.",
    "mailchi.mp", "list-manage", "sendgrid", "mailgun",
)
LINK_TRACKER = "|".join(t.replace(".", r"\.") for t in LINK_TRACKERS)

# Notification categories by subject type, then by delivery reason.
SUBJECT_CATEGORIES = {
    "Release": "release",
    "CheckSuite": "ci",
    "RepositoryVulnerabilityAlert": "dependabot",
}
REASON_CATEGORIES = {
    "ci_activity": "ci",
    "review_requested": "review",
    "approval_requested": "review",
    "mention": "mention",
    "team_mention": "mention",
    "assign": "assignment",
    "security_alert": "dependabot",
    "security_advisory_credit": "dependabot",
}
VERSION_BUMP_TITLE = r"(?iU)^Bump \S+ from \S+ to \S+"

# Attendance answers of calendar files.
PARTSTAT = {
    "ACCEPTED": "accepted",
    "DECLINED": "declined",
    "TENTATIVE": "tentative",
    "NEEDS-ACTION": "needsAction",
    "DELEGATED": "delegated",
}
# Weekday names of recurrence rules.
RULE_DAYS = {"MO": "Mon", "TU": "Tue", "WE": "Wed", "TH": "Thu", "FR": "Fri", "SA": "Sat", "SU": "Sun"}
PATTERN_DAYS = {
    "sunday": "Sun", "monday": "Mon", "tuesday": "Tue", "wednesday": "Wed",
    "thursday": "Thu", "friday": "Fri", "saturday": "Sat",
}

# The domain of chat identifiers and the ending of group chats.
CHAT_DOMAIN = "@s.whatsapp.net"
GROUP_DOMAIN = "@g.us"

# Names of the canonical sources, and the providers that are cached.
SOURCE_LABELS = {"g": "gmail", "o": "o365", "w": "whatsapp"}
CACHED_PROVIDERS = ("gmail", "o365")
CALENDAR_PROVIDERS = ("gcal", "o365cal", "caldav")
CONTACT_PROVIDERS = ("carddav",)
PROVIDER_ALIASES = {
    "wa": "whatsapp", "outlook": "o365", "office": "o365", "365": "o365", "gh": "github",
    "google-calendar": "gcal", "calendar": "gcal", "cal": "gcal",
    "o365-calendar": "o365cal", "outlook-calendar": "o365cal",
    "apple": "caldav", "icloud": "caldav", "apple-calendar": "caldav",
}
# Mailbox labels that are counted, in listing order.
COUNTED_LABELS = (
    ("INBOX", "Inbox"),
    ("CATEGORY_PERSONAL", "Primary"),
    ("CATEGORY_SOCIAL", "Social"),
    ("CATEGORY_PROMOTIONS", "Promotions"),
    ("CATEGORY_UPDATES", "Updates"),
    ("CATEGORY_FORUMS", "Forums"),
    ("SPAM", "Spam"),
    ("TRASH", "Trash"),
)
# Access levels in rising order.
LEVELS = ("readonly", "modify", "draft", "send")
SCHEMA_VERSION = 3

# Where a forwarded message begins; what follows is not the sender's own text.
FORWARD_MARK = r"(?is)(?:^|\n)[ \t]*(?:-+ ?forwarded message ?-+|begin forwarded message:).*$"
