"""Tables of the price-list domain, as schemas in words that Spark reads."""

MONEY = "decimal(18,4)"
SUPPLIERS = "id string, name string, email string, phone string, address string, created_at timestamp_ntz"
PRODUCTS = "id string, raw_name string, name string, standardized_name string, category string, unit string, standardized_unit string, description string, created_at timestamp_ntz"
ALIASES = "id string, product_id string, alias string, language string"
PRICES = f"id string, amount {MONEY}, unit string, unit_price {MONEY}, supplier_id string, product_id string, upload_id string, valid_from timestamp_ntz, valid_to timestamp_ntz, created_at timestamp_ntz"
UPLOADS = "id string, original_name string, file_size int, mime_type string, status string, supplier_id string, extracted_data string, completeness_ratio double, processing_cost_usd double, processing_time_ms int, tokens_used int, total_rows_detected int, total_rows_processed int, approval_status string, created_at timestamp_ntz"
HISTORY = f"product_id string, supplier_id string, price {MONEY}, unit string, unit_price {MONEY}, quantity {MONEY}, changed_from {MONEY}, change_percentage double, change_reason string, upload_id string, created_at timestamp_ntz"
UNMATCHED = "raw_name string, normalized_name string, context string, supplier_id string, frequency int, status string, assigned_product_id string"
WORDS = "source_word string, target_word string, language string, category string"
UNIT_WORDS = "source_unit string, target_unit string, conversion_factor double, category string"
ITEMS = "item_id long, product_name string, supplier_id string, scanned_price double, unit string, quantity double"
EXTRACTED = "name string, price double, unit string, category string, confidence double, description string, source_sheet string, source_row int"
EXTRACTED_JSON = "supplier struct<name:string,email:string,phone:string,address:string>, products array<struct<product:string,uom:string,size:string,pack_qty:double,price:double,price_type:string>>, metadata struct<document_type:string,file_hash:string,total_rows:int,processed_rows:int,extraction_method:string,processing_time_ms:double>"
