"""Text of web pages as a chain of built-in expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankforge.functions.text import strip

# What is dropped, what breaks a line, which entities are read.
DROPPED = r"(?is)<(script|style|head|nav)\b.*?</(script|style|head|nav)>|<!--.*?-->"
BLOCK_TAG = r"(?i)</?(p|div|br|h[1-6]|li|tr|article|section|ul|ol|table)\b[^>]*>"
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def html_text(html: Column) -> Column:
    text = F.regexp_replace(html, DROPPED, " ")
    text = F.regexp_replace(F.regexp_replace(text, BLOCK_TAG, "\n"), r"<[^>]*>", "")
    for entity, plain in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(plain))
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t\r\f]+", " "), r" ?\n[ \n]*", "\n")
    return strip(text)
