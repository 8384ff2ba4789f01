"""The field registry: what an invoice record holds, how each field is typed, read, grouped and located."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SETTLEMENT = "CrossIndustryInvoice/SupplyChainTradeTransaction/ApplicableHeaderTradeSettlement"
_AGREEMENT = "CrossIndustryInvoice/SupplyChainTradeTransaction/ApplicableHeaderTradeAgreement"
_DELIVERY = "CrossIndustryInvoice/SupplyChainTradeTransaction/ApplicableHeaderTradeDelivery"
_DOCUMENT = "CrossIndustryInvoice/ExchangedDocument"
_TOTALS = _SETTLEMENT + "/SpecifiedTradeSettlementHeaderMonetarySummation"
_TERMS = _SETTLEMENT + "/SpecifiedTradePaymentTerms"
_MEANS = _SETTLEMENT + "/SpecifiedTradeSettlementPaymentMeans"

# Key, EN 16931 term, label, type, reader ('' for that of the type), group, element path.
FIELDS = [
    ("invoice_number", "BT-1", "Rechnungsnummer", "CODE", "invoice_number", "", _DOCUMENT + "/ID"),
    ("issue_date", "BT-2", "Rechnungsdatum", "DATE", "", "", _DOCUMENT + "/IssueDateTime/DateTimeString"),
    ("invoice_currency_code", "BT-5", "Währung", "CODE", "", "", _SETTLEMENT + "/InvoiceCurrencyCode"),
    ("delivery_date", "BT-72", "Liefer-/Leistungsdatum", "DATE", "", "", _DELIVERY + "/ActualDeliverySupplyChainEvent/OccurrenceDateTime/DateTimeString"),
    ("seller_name", "BT-27", "Verkäufer", "STRING", "", "seller", _AGREEMENT + "/SellerTradeParty/Name"),
    ("seller_vat_id", "BT-31", "USt-IdNr. (Verkäufer)", "CODE", "", "seller", _AGREEMENT + "/SellerTradeParty/SpecifiedTaxRegistration/ID[@schemeID='VA']"),
    ("seller_tax_id", "BT-32", "Steuernummer", "CODE", "", "seller", _AGREEMENT + "/SellerTradeParty/SpecifiedTaxRegistration/ID[@schemeID='FC']"),
    ("seller_gln", "BT-29", "GLN (Verkäufer)", "CODE", "", "seller", _AGREEMENT + "/SellerTradeParty/GlobalID[@schemeID='0088']"),
    ("buyer_name", "BT-44", "Käufer", "STRING", "", "buyer", _AGREEMENT + "/BuyerTradeParty/Name"),
    ("buyer_reference", "BT-46", "Kundennummer", "CODE", "", "buyer", _AGREEMENT + "/BuyerTradeParty/ID"),
    ("buyer_vat_id", "BT-48", "USt-IdNr. (Käufer)", "CODE", "", "buyer", _AGREEMENT + "/BuyerTradeParty/SpecifiedTaxRegistration/ID[@schemeID='VA']"),
    ("line_total_amount", "BT-106", "Summe Nettobeträge", "MONEY", "", "totals", _TOTALS + "/LineTotalAmount"),
    ("tax_basis_total_amount", "BT-109", "Steuerlicher Bemessungsbetrag", "MONEY", "", "totals", _TOTALS + "/TaxBasisTotalAmount"),
    ("tax_total_amount", "BT-110", "Umsatzsteuer gesamt", "MONEY", "", "totals", _TOTALS + "/TaxTotalAmount"),
    ("grand_total_amount", "BT-112", "Bruttobetrag", "MONEY", "", "totals", _TOTALS + "/GrandTotalAmount"),
    ("due_payable_amount", "BT-115", "Zahlbetrag", "MONEY", "", "totals", _TOTALS + "/DuePayableAmount"),
    ("tax_rate", "BT-119", "Umsatzsteuersatz", "RATE", "", "", _SETTLEMENT + "/ApplicableTradeTax/RateApplicablePercent"),
    ("seller_address", "BG-5", "Anschrift (Verkäufer)", "STRING", "", "seller", _AGREEMENT + "/SellerTradeParty/PostalTradeAddress"),
    ("buyer_address", "BG-8", "Anschrift (Käufer)", "STRING", "", "buyer", _AGREEMENT + "/BuyerTradeParty/PostalTradeAddress"),
    ("document_type", "BT-3", "Belegart", "CODE", "", "", _DOCUMENT + "/TypeCode"),
    ("buyer_order_reference", "BT-13", "Bestellnummer", "CODE", "", "", _AGREEMENT + "/BuyerOrderReferencedDocument/IssuerAssignedID"),
    ("billing_period_start", "BT-73", "Abrechnungszeitraum Beginn", "DATE", "", "", _SETTLEMENT + "/BillingSpecifiedPeriod/StartDateTime/DateTimeString"),
    ("billing_period_end", "BT-74", "Abrechnungszeitraum Ende", "DATE", "", "", _SETTLEMENT + "/BillingSpecifiedPeriod/EndDateTime/DateTimeString"),
    ("payment_due_date", "BT-9", "Fälligkeitsdatum (Zahlungsziel)", "DATE", "", "payment", _TERMS + "/DueDateDateTime/DateTimeString"),
    ("payment_means_code", "BT-81", "Zahlungsart (Code)", "CODE", "", "payment", _MEANS + "/TypeCode"),
    ("payment_means_text", "BT-82", "Zahlungsart", "STRING", "", "payment", _MEANS + "/Information"),
    ("seller_iban", "BT-84", "IBAN (Zahlungsempfänger)", "CODE", "", "payment", _MEANS + "/PayeePartyCreditorFinancialAccount/IBANID"),
    ("seller_bic", "BT-86", "BIC", "CODE", "", "payment", _MEANS + "/PayeeSpecifiedCreditorFinancialInstitution/BICID"),
    ("seller_account_name", "BT-85", "Kontoinhaber", "STRING", "", "payment", _MEANS + "/PayeePartyCreditorFinancialAccount/AccountName"),
    ("payment_reference", "BT-83", "Verwendungszweck", "STRING", "", "payment", _SETTLEMENT + "/PaymentReference"),
    ("prepaid_amount", "BT-113", "Bereits gezahlt", "MONEY", "unsigned_money", "totals", _TOTALS + "/TotalPrepaidAmount"),
    ("allowance_total_amount", "BT-107", "Summe Nachlässe", "MONEY", "unsigned_money", "totals", _TOTALS + "/AllowanceTotalAmount"),
    ("charge_total_amount", "BT-108", "Summe Zuschläge", "MONEY", "unsigned_money", "totals", _TOTALS + "/ChargeTotalAmount"),
    ("rounding_amount", "BT-114", "Rundungsbetrag", "MONEY", "optional_money", "totals", _TOTALS + "/RoundingAmount"),
]

# The cells of rows that repeat: row group, key, term, type, reader, element path in the row.
GROUP_FIELDS = [
    ("vat_breakdown", "category_code", "BT-118", "CODE", "vat_category", "CategoryCode"),
    ("vat_breakdown", "rate_percent", "BT-119", "RATE", "", "RateApplicablePercent"),
    ("vat_breakdown", "taxable_amount", "BT-116", "MONEY", "", "BasisAmount"),
    ("vat_breakdown", "tax_amount", "BT-117", "MONEY", "", "CalculatedAmount"),
    ("skonto", "percent", "BT-DE-skonto-percent", "RATE", "", "CalculationPercent"),
    ("skonto", "days", "BT-DE-skonto-days", "CODE", "", "BasisPeriodMeasure"),
    ("skonto", "basis_amount", "BT-DE-skonto-basis", "MONEY", "", "BasisAmount"),
    ("line_items", "line_id", "BT-126", "CODE", "", "AssociatedDocumentLineDocument/LineID"),
    ("line_items", "name", "BT-153", "STRING", "", "SpecifiedTradeProduct/Name"),
    ("line_items", "seller_assigned_id", "BT-155", "CODE", "article_id", "SpecifiedTradeProduct/SellerAssignedID"),
    ("line_items", "net_price", "BT-146", "MONEY", "", "SpecifiedLineTradeAgreement/NetPriceProductTradePrice/ChargeAmount"),
    ("line_items", "quantity", "BT-129", "MONEY", "", "SpecifiedLineTradeDelivery/BilledQuantity"),
    ("line_items", "vat_rate", "BT-152", "RATE", "", "SpecifiedLineTradeSettlement/ApplicableTradeTax/RateApplicablePercent"),
    ("line_items", "line_amount", "BT-131", "MONEY", "", "SpecifiedLineTradeSettlement/SpecifiedTradeSettlementLineMonetarySummation/LineTotalAmount"),
]

#: Rows of each group in an invoice.
GROUP_ROWS = {
    "vat_breakdown": _SETTLEMENT + "/ApplicableTradeTax",
    "skonto": _TERMS + "/ApplicableTradePaymentDiscountTerms",
    "line_items": "CrossIndustryInvoice/SupplyChainTradeTransaction/IncludedSupplyChainTradeLineItem",
}

# Container names of the older schema.
OLDER_NAMES = {
    "CrossIndustryInvoice": "CrossIndustryDocument",
    "ExchangedDocument": "HeaderExchangedDocument",
    "SupplyChainTradeTransaction": "SpecifiedSupplyChainTradeTransaction",
    "ApplicableHeaderTradeAgreement": "ApplicableSupplyChainTradeAgreement",
    "ApplicableHeaderTradeDelivery": "ApplicableSupplyChainTradeDelivery",
    "ApplicableHeaderTradeSettlement": "ApplicableSupplyChainTradeSettlement",
    "SpecifiedTradeSettlementHeaderMonetarySummation": "SpecifiedTradeSettlementMonetarySummation",
    "SpecifiedLineTradeAgreement": "SpecifiedSupplyChainTradeAgreement",
    "SpecifiedLineTradeDelivery": "SpecifiedSupplyChainTradeDelivery",
    "SpecifiedLineTradeSettlement": "SpecifiedSupplyChainTradeSettlement",
}

#: Fields whose stored value is a code that no page prints.
NEVER_PRINTED = ["document_type", "payment_means_code"]
#: Optional totals: a stored zero is no statement.
OPTIONAL_TOTALS = ["allowance_total_amount", "charge_total_amount", "prepaid_amount", "rounding_amount"]
#: Parts of an address, in order.
ADDRESS_PARTS = ["LineOne", "LineTwo", "LineThree", "PostcodeCode", "CityName", "CountryID"]


def registry(spark: SparkSession) -> DataFrame:
    """One row for each field, flat ones first; small by design, so joins broadcast it."""
    rows = [(k, "", n, bt, label, kind, reader or kind, group) for n, (k, bt, label, kind, reader, group, _) in enumerate(FIELDS)]
    rows += [(k, g, len(FIELDS) + n, bt, None, kind, reader or kind, g) for n, (g, k, bt, kind, reader, _) in enumerate(GROUP_FIELDS)]
    return spark.createDataFrame(rows, "field_key string, row_group string, ordinal int, term string, label string, field_type string, rule string, field_group string")
