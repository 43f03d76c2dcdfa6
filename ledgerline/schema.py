"""The ledger's columns and the fixed values of its operators."""

LEDGER = "txn_id string, account_id string, posted_date date, amount decimal(12,2), amount_text string, currency string, raw_description string, source_format string, source_file string, row_no int"

# Canonical merchants (their order breaks ties), tokens that stand for one, and location tokens.
MERCHANTS = [
    "Acme Corp Payroll", "Ally Bank Interest", "Meridian Properties", "Georgia Power", "City Water Dept", "Xfinity Internet", "Verizon Wireless", "Kroger", "Whole Foods Market",
    "Blue Bottle Coffee", "Starbucks", "Chipotle", "Chick-fil-A", "The Local Tavern", "Olive Branch Bistro", "DoorDash", "Shell Oil", "Chevron", "Uber", "Lyft", "MARTA", "ParkMobile",
    "Amazon", "Target", "Best Buy", "Apple Store", "H&M", "IKEA", "CVS Pharmacy", "Piedmont Medical", "Anytime Fitness", "Netflix", "Spotify", "AMC Theatres", "Steam", "Delta Air Lines",
    "Marriott", "Hertz", "Chase Bank Fee", "Chase Interest Charge",
]
DOMAIN_ALIASES = {
    "STEAMGAMES": "Steam", "BESTBUY": "Best Buy", "APPLE.COM": "Apple Store", "AMZN": "Amazon", "AMAZON.COM": "Amazon", "SBUX": "Starbucks", "WHOLEFDS": "Whole Foods Market",
}
PLACES = ["GA", "TX", "CO", "WA", "ID", "FL", "NY", "CA", "US", "ATLANTA", "AUSTIN", "DENVER", "SEATTLE", "BOISE", "TAMPA"]
# Category by exact merchant, then by keyword in this order.
MERCHANT_RULES = {
    "Meridian Properties": "Housing>Rent", "Georgia Power": "Utilities>Electricity", "City Water Dept": "Utilities>Water", "Xfinity Internet": "Utilities>Internet",
    "Verizon Wireless": "Utilities>Phone", "Anytime Fitness": "Health>Fitness", "Netflix": "Entertainment>Streaming", "Spotify": "Entertainment>Streaming",
    "Acme Corp Payroll": "Income>Salary", "Ally Bank Interest": "Income>Interest", "Kroger": "Food & Drink>Groceries", "Whole Foods Market": "Food & Drink>Groceries",
    "Blue Bottle Coffee": "Food & Drink>Coffee", "Starbucks": "Food & Drink>Coffee", "Chipotle": "Food & Drink>Fast Food", "Chick-fil-A": "Food & Drink>Fast Food",
    "Shell Oil": "Transport>Gas", "Chevron": "Transport>Gas", "Chase Bank Fee": "Fees & Interest>Bank Fees", "Chase Interest Charge": "Fees & Interest>Interest Charges",
}
KEYWORD_RULES = {
    "OVERDRAFT FEE": "Fees & Interest>Bank Fees", "MONTHLY SERVICE FEE": "Fees & Interest>Bank Fees", "INTEREST CHARGE ON PURCHASES": "Fees & Interest>Interest Charges", "INTEREST PAYMENT": "Income>Interest",
}
# Words that mark a transfer.
TRANSFER_WORDS = "TRANSFER|ZELLE|PAYMENT THANK YOU|PMT TO|PAYMENT"
INTERNAL_TRANSFER = "Transfers>Internal Transfer"
FALLBACK = "Other>Uncategorized"
# Periods (name, days, tolerance, a year has).
PERIODS = [("weekly", 7, 2, 52), ("biweekly", 14, 3, 26), ("monthly", 30, 3, 12), ("quarterly", 91, 7, 4), ("annual", 365, 14, 1)]
# Header rows by bank format.
HEADERS = {
    "chase": ["Details", "Posting Date", "Description", "Amount", "Type"],
    "boa": ["Date", "Description", "Debit", "Credit"],
    "capital_one": ["Transaction Date", "Posted Date", "Description", "Category", "Debit", "Credit"],
    "generic_credit": ["Date", "Description", "Amount", "Type"],
}
# Categories that one bank prints beside a transaction whether they fit or not.
BANK_HINTS = ["Merchandise", "Dining", "Travel-Airfare", "Groceries", "Payment/Credit", "Fees", "Gas/Automotive", "Entertainment"]
