"""Schemas of the tables and of nested values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MCQ = "struct<question:string,options:map<string,string>,correct_option:string,explanation:string,difficulty:string,topic_tag:string>"
VERDICT = "struct<is_valid:boolean,quality_score:double,critique:string>"
EXTRACTION = "struct<text:string,is_valid:boolean,error_message:string,page_count:int,used_ocr_pages:array<int>,failed_pages:array<int>>"

TABLES = {
    "users": "id string, email string, password_hash string, role string, created_at timestamp, updated_at timestamp",
    "documents": "id string, user_id string, source_type string, filename string, file_path string, file_size_bytes long, title string, status string, extracted_text string, target_questions int, total_pages int, progress_page int, created_at timestamp, updated_at timestamp",
    "topic_list": "id string, slug string, name string, sort_order int, created_at timestamp",
    "generated_tests": "id string, user_id string, document_id string, title string, status string, prompt_version string, model string, generation_metadata string, estimated_input_tokens int, estimated_output_tokens int, estimated_cost_usd decimal(12,6), failure_reason string, target_questions int, questions_generated int, progress_mcq int, total_mcq int, created_at timestamp, updated_at timestamp",
    "questions": "id string, generated_test_id string, sort_order int, question string, options map<string,string>, correct_option string, explanation string, difficulty string, topic_id string, validation_result string, created_at timestamp, updated_at timestamp",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def evolved(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both, under the columns of both; missing ones are null."""
    return new.unionByName(old, allowMissingColumns=True)
