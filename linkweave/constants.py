"""Fixed values. They must equal the service's own values, or ids, tokens and outcomes differ."""

# Alphabet and length of a short id, and the number of tries before a request fails.
ID_CHARSET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
ID_LENGTH = 8
MAX_ATTEMPTS = 5

# A user's delete buffer is flushed when it holds this many ids, or when the tick comes.
DELETE_BATCH_SIZE = 100
DELETE_TICK_MS = 10

# Width of the two VARCHAR columns of the link table.
MAX_KEY_CHARS = 255

# Audit actions.
ACTION_SHORTEN = "shorten"
ACTION_FOLLOW = "follow"

# Request outcomes.
OK = 200
CREATED = 201
ACCEPTED = 202
NO_CONTENT = 204
FOLLOWED = 307
BAD_REQUEST = 400
UNAUTHORIZED = 401
NOT_FOUND = 404
METHOD_NOT_ALLOWED = 405
CONFLICT = 409
GONE = 410
FAILED = 500

# Content types that may be sent compressed.
COMPRESSIBLE = ("application/json", "text/html")

# The code points with the Unicode White_Space property.
WHITE_SPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
