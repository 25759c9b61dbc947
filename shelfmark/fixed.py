"""Fixed values.

Every string below must equal the command-line tool this engine replaces,
byte for byte, or the reports, CSV files and grids it writes would differ.
They are stated once, here, in the order the tool uses them.
"""

# Validation outcome types and messages.
TYPE_INVALID = "Invalid"
TYPE_ISBN10 = "ISBN10"
TYPE_ISBN13 = "ISBN13"
MSG_BAD_ISBN13 = "Invalid ISBN-13 checksum"
MSG_BAD_ISBN10 = "Invalid ISBN-10 checksum"
MSG_BAD_FORMAT = "Invalid ISBN format (must be 10 or 13 digits)"

# ISBN-13 prefixes accepted by the checksum rule.
ISBN13_PREFIXES = ("978", "979")

# Resolution.
PROVIDER_A_KEY_PREFIX = "ISBN:"
MSG_UNRESOLVED = "failed to resolve ISBN from all APIs"
IDENTIFIER_TYPE_10 = "ISBN_10"
IDENTIFIER_TYPE_13 = "ISBN_13"

# Spreadsheet column scan.
SHEET_HEADER_CELLS = ("isbn", "isbn-10", "isbn-13", "isbn number")
SHEET_STRIP_CHARS = " -."
SHEET_ID_PATTERN = r"/spreadsheets/d/([a-zA-Z0-9-_]+)"
MSG_RANGE_EMPTY = "range cannot be empty"
MSG_NO_DATA = "no data found in range: %s"
MSG_NO_IDS = "no valid ISBNs found in range: %s"
MSG_NO_INPUT = "No ISBNs provided"
MSG_NO_VALID = "No valid ISBNs to process"
MSG_RANGE_FORMAT = "invalid range format: %s (use A1 notation like 'A2:A' or 'Sheet1!A2:A')"

# Output formats.
CSV_HEADER = (
    "ISBN", "ISBN-13", "Title", "Authors", "Publisher",
    "Publication Date", "Pages", "Categories", "Status", "Error",
)
GRID_HEADER = (
    "ISBN-13", "Title", "Authors", "Publisher",
    "Publication Date", "Pages", "Categories", "Status", "Error",
)
CSV_LIST_SEP = "; "
TEXT_LIST_SEP = ", "
GRID_LIST_SEP = ", "
STATUS_SUCCESS = "success"
STATUS_ERROR = "error"
GRID_STATUS_SUCCESS = "Success"
GRID_STATUS_ERROR = "Error"
TEXT_OK = "Status: ✓ Resolved"
TEXT_FAILED = "Status: ✗ Failed - "
TEXT_RECORD_END = "\n\n---\n\n"
TEXT_LABELS = (
    "ISBN: ", "ISBN-13: ", "Title: ", "Authors: ", "Publisher: ",
    "Publication Date: ", "Pages: ", "Categories: ",
)
MSG_FORMAT = "unsupported format: %s (one of %s)"

# Dry-run preview.
PREVIEW_ROWS = 5
PREVIEW_TITLE = "DRY RUN - Preview of changes:"
PREVIEW_TARGET = "Spreadsheet ID: %s"
PREVIEW_RANGE = "Output Range: %s"
PREVIEW_NEW_TAB = "Would create new tab: %s"
PREVIEW_TOTAL = "Would write %d rows:"
PREVIEW_ROW = "Row %d: [%s]"
PREVIEW_MORE = "... and %d more rows"
PREVIEW_NOTE = "No changes were made (dry run mode)"
