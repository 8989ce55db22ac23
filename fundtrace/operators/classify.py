"""Security classification with rules as ordered tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shape of a stock's ticker, names that a trust may have as a company, and names of what is no company equity, in order.
TICKER = r"^[A-Z]{1,5}([.-][A-Z])?$"
TRUST_NAMES = ["REALTY", "PROPERTIES", "PROPERTY", "REIT", "BANCORP", "BANK", "BANKS", "CORP", "INC", "CO", "NORTHERN TRUST", "SUNTRUST", "SOUTHTRUST"]
EXCLUDED_NAMES = [
    "FUND", "FUNDS", "SERIES", "ADVISER SERIES", "INDEXIQ", "POWERSHARES", "DIAMONDS TRUST", "NASDAQ 100 TRUST", "E T F", "ET SELF INDEX", "LIQUIDITY FUNDS",
    "CL [A-Z0-9]+ MF", "MF", "FD", "INDEX", "INDEX FUND", "BND INDEX FUND", "MUTUAL FUND", "EXCHANGE TRADED FUND", "ETF", "ETN", "ISHARES", "SPDR", "VANGUARD",
    "PROSHARES", "DIREXION", "INVESCO QQQ", "SCHWAB US AGGREGATE", "PORTFOLIO", "SEPARATE ACCOUNT", "MASTER PORTFOLIO",
    "BOND", "BONDS", "NOTE", "NOTES", "DEBENTURE", "DEBENTURES", r"SENIOR\b.*\bDUE", "SUBORDINATED", "CONVERTIBLE NOTE", "CORPORATE NOTE", "CAPITAL CORP",
    "MUNICIPAL", "MUNI", "MED TERM", "MEDIUM TERM", "MTN", r"CAP\(MED TERM", "TRUST PFD", "PFD", "PREFERRED", "FIXED INCOME", "HIGH YIELD", "FLOATING RATE",
    "TREASURY", "T-BILL", "TBILL", "BILL", "BILLS", "UNITED STATES TREAS", "U S TREAS", "US TREAS", "GOVERNMENT", "FEDERAL", "FNMA", "FHLMC", "GNMA",
    "FANNIE MAE", "FREDDIE MAC", "GINNIE MAE", "DEPOSIT", "TIME/TERM DEPOSIT", "EURODOLLAR", "MONEY MARKET", "CASH", "REPURCHASE", "COMMERCIAL PAPER",
    "CERTIFICATE OF DEPOSIT", "CD", "OPTION", "OPTIONS", "FUTURE", "FUTURES", "SWAP", "SWAPS", "WARRANT", "RIGHTS", "FORWARD", "COLLATERAL", "MORTGAGE",
    "ASSET BACKED", "ABS", "MBS", "CMBS",
]
#: Tickers and names of the two groups of what is left out, and of their parts.
BOND_TICKERS = "AGG BND LQD HYG JNK TLT IEF SHY TIP MUB BIL SHV MBB VCIT VCSH VCLT IGSB IGIB IGLB EMB BIV BSV BLV".split()
EQUITY_TICKERS = (
    "SPY IVV VOO VTI QQQ DIA IWM EFA IEFA EEM IEMG VEA VWO IJH IJR IWF IWD IVE IVW VUG VTV VO VB MDY RSP XLK XLF XLV XLY XLI XLP XLE XLB XLU XLC XLRE"
).split()
FUND_LIKE = [
    "ETF", "EXCHANGE TRADED", "FUND", "FUNDS", "PORTFOLIO", "PORTFOLIOS", "TRUST", "SPDR", "ISHARES", "VANGUARD", "INVESCO", "POWERSHARES", "BLACKROCK",
    "STATE STREET", "FIDELITY", "SCHWAB",
]
BOND_MONEY = [
    "CASH", "USD", "MONEY MARKET", "MMF", "DEPOSIT", "TIME DEPOSIT", "CERTIFICATE OF DEPOSIT", "REPO", "REPURCHASE", "SWEEP", "RESERVE", "LIQUIDITY",
    "TREAS", "TREASURY", "UNITED STATES", "U S", "US GOV", "GOVERNMENT", "FEDERAL", "FANNIE MAE", "FNMA", "FREDDIE MAC", "FHLMC", "GINNIE MAE", "GNMA",
    "TBA", "MBS", "MORTGAGE", "AGENCY", "NATL MORTGAGE", "BOND", "FIXED INCOME", "INCOME FUND", "CREDIT", "HIGH YIELD", "NOTE", "NOTES", "DEBENTURE", "MTN",
    "MEDIUM TERM", "LOAN", "PREFERRED", "PFD", "SWAP", "FUTURE", "FUTURES", "FORWARD", "OPTION", "WARRANT", "COLLATERAL", "STRUCTURED",
]
EQUITY_FUND = [
    "STOCK FUND", "EQUITY", "COMMON STOCK", "TOTAL STOCK MARKET", "STOCK MARKET", "S&P", "S P 500", "NASDAQ", "RUSSELL", "DOW", "LARGE CAP", "MID CAP",
    "SMALL CAP", "GROWTH", "VALUE", "INTERNATIONAL", "EMERGING MARKETS", "DEVELOPED MARKETS", "MSCI",
]
INCOME_LIKE = ["INCOME", "RESERVE", "SHORT TERM", "ULTRA SHORT"]
CASH_PART = ["CASH", "MONEY MARKET", "DEPOSIT", "REPO", "LIQUIDITY", "RESERVE"]
GOVERNMENT_PART = [r"TREAS\w*", "GOVERNMENT", "UNITED STATES", "FEDERAL", "FANNIE", "FREDDIE", "GINNIE", "MBS", "TBA", "MORTGAGE"]
BOND_INDEX_PART = ["BOND ETF", "TOTAL BOND", "AGGREGATE BOND"]
CREDIT_PART = ["BOND", "FIXED INCOME", "CREDIT", "HIGH YIELD", "PREFERRED", "NOTE", "LOAN"]
DERIVATIVE_PART = ["SWAP", "FUTURE", "FORWARD", "OPTION", "COLLATERAL", "STRUCTURED"]
PASSIVE_PART = ["ETF", "SPDR", "ISHARES", "VANGUARD"]
STOCK_FUND_PART = ["STOCK FUND", "EQUITY", "TOTAL STOCK", "S&P", "RUSSELL", "NASDAQ", "MSCI"]
BOND, EQUITY = "Bond / Credit / Money-related", "Equity Fund / Stock-fund-like"
SECTOR_NAMES = {"tech": "Technology", "information technology": "Technology", "financials": "Financial Services", "consumer discretionary": "Consumer Cyclical", "consumer staples": "Consumer Defensive"}


def any_of(names: list[str]) -> str:
    """Pattern of any of the names as whole words."""
    return rf"\b(?:{'|'.join(names)})\b"


def exclusion_reason(name: str, ticker: str) -> Column:
    """Why a security is no company equity, by the first rule that holds; null if it is one.

    In order: shape of the ticker, name missing, five letters with X at the end, a trust without a company's name, and the
    names that are left out.
    """
    n, t = F.upper(F.trim(F.coalesce(name, F.lit("")))), F.regexp_replace(F.upper(F.coalesce(ticker, F.lit(""))), r"\s", "")
    out = (
        F.when(t.isin("NA", "NULL", "NONE") | ~t.rlike(TICKER), "invalid_or_missing_ticker").when(n == "", "missing_security_name")
        .when(t.rlike("^.{4}X$"), "likely_mutual_fund_ticker_5_letters_ending_x")
        .when(n.contains("TRUST") & ~n.rlike(any_of(TRUST_NAMES)), "excluded_trust_not_likely_company_equity")
    )
    # most names match none: one pattern of all says so
    out = out.when(~n.rlike(any_of(EXCLUDED_NAMES)), None)
    for x in EXCLUDED_NAMES:
        out = out.when(n.rlike(any_of([x])), rf"excluded_name_pattern:\b{x}\b")
    return out


def two_groups(items: DataFrame, name: str, ticker: str, reason: str, company: str) -> DataFrame:
    """Add group, part, exposure, confidence (high or review) and whether an item looks like a single stock.

    ``company``: a column that says whether the ticker is one of the company universe. Missing text counts as empty.
    """
    t = F.replace(F.upper(F.trim(F.coalesce(ticker, F.lit("")))), F.lit("."), F.lit("-"))
    text = F.concat(F.lit(" "), t, F.lit(" "), *[x for c in (name, reason) for x in (F.upper(F.trim(F.coalesce(c, F.lit("")))), F.lit(" "))])
    df = items.withColumn("_t", t).withColumn("_text", text)
    has = lambda names: F.col("_text").rlike(any_of(names))
    df = df.withColumns({"_fund": has(FUND_LIKE), "_money": has(BOND_MONEY), "_income": has(INCOME_LIKE)})
    bond = F.col("_t").isin(BOND_TICKERS) | F.col("_money")
    equity = F.col("_t").isin(EQUITY_TICKERS) | (F.col("_fund") & has(EQUITY_FUND))
    df = df.withColumns({
        "category": F.when(bond, BOND).when(equity, EQUITY).when(F.col("_fund") & ~F.col("_income"), EQUITY).otherwise(BOND),
        "exposure": F.when(bond, "Fixed income / credit / liquidity / interest-rate exposure").when(equity, "Indirect equity / passive stock index exposure")
        .when(F.col("_fund") & F.col("_income"), "Possible income or liquidity allocation").when(F.col("_fund"), "Possible indirect fund exposure")
        .otherwise("Other money-related / manual review"),
        "confidence": F.when(bond | equity, "high").otherwise("review"),
        "stock_like": F.coalesce(F.col(company), F.lit(False)) & (F.col("_t") != "") & ~F.col("_money") & ~F.col("_fund"),
    })
    of_bond = (
        F.when(has(CASH_PART), "Cash / money market / liquidity").when(has(GOVERNMENT_PART), "Government / agency / Treasury / MBS")
        .when(F.col("_t").isin(BOND_TICKERS) | has(BOND_INDEX_PART), "Bond ETF / bond index product").when(has(CREDIT_PART), "Corporate credit / fixed income")
        .when(has(DERIVATIVE_PART), "Derivative / structured financial exposure").otherwise("Other money-related / fixed-income-like")
    )
    of_equity = (
        F.when(F.col("_t").isin(EQUITY_TICKERS) | has(PASSIVE_PART), "Equity ETF / passive index product")
        .when(has(STOCK_FUND_PART), "Stock fund / equity index fund").otherwise("Other equity fund-like holding")
    )
    return df.withColumn("subcategory", F.when(F.col("category") == BOND, of_bond).otherwise(of_equity)).drop("_t", "_text", "_fund", "_money", "_income")


def classified_items(raw: DataFrame, category: str, name: str, ticker: str) -> DataFrame:
    """Rows of a classified-item source that have a category and a name or a ticker, trimmed, with a label for display."""
    text = {c: F.trim(F.coalesce(c, F.lit(""))) for c in (category, name, ticker)}
    rows = raw.withColumns(text).where((F.col(category) != "") & ((F.col(name) != "") | (F.col(ticker) != "")))
    both = F.concat_ws(" | ", ticker, F.when(F.col(name) != "", F.col(name)).otherwise(F.col(ticker)))
    return rows.withColumn("item_label", F.when(F.col(ticker) != "", both).otherwise(F.col(name)))


def normal_sector(sector: str) -> Column:
    """Sector by the table of names; others stay."""
    table = F.create_map(*[F.lit(x) for kv in SECTOR_NAMES.items() for x in kv])
    return F.coalesce(F.element_at(table, F.lower(F.trim(sector))), F.trim(sector))


def excluded_audit(rows: DataFrame, keys: list[str], date: str, portfolio: str) -> DataFrame:
    """Excluded rows by identity and reason (the last key): first and last date, rows and portfolios. Null keys are a group."""
    kept = rows.where(F.col(keys[-1]).isNotNull())
    return kept.groupBy(*keys).agg(F.min(date).alias("first_dt"), F.max(date).alias("last_dt"), F.count("*").alias("records"), F.count_distinct(portfolio).alias("portfolios"))
