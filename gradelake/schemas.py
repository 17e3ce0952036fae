"""Table shapes used across the package, as DDL strings. Document-level tables start with doc_id."""

from __future__ import annotations

# Texts and names of the response format.
MESSAGE = "Smart OCR complete."
GRID_VERSION = "v4"
RESPONSE_NAME_RE = r"^smart_ocr_response_(.+)\.json$"

ANCHOR = "struct<type:string,rows:array<string>,extra:map<string,string>>"

TABLES = {
    "key_uploads": "id string, owner_user_id string, title string, lang string, pdf_path string, booklet_type string, created_seq bigint",
    "answer_models": "id string, owner_user_id string, title string, lang string, booklet_type string, booklet_pdf_path string, question_count int, intro_page int, created_seq bigint",
    "questions": "model_id string, pos int, id string, question_no string, title string, desc_text string, instruction_name string, page_num int, marks int, diagrams array<string>",
    "page_grid": "doc_id string, page int, rows int, cols int, cell_size_pts double, left_margin_pts double, top_margin_pts double, page_w_pts double, page_h_pts double",
    "cells": "doc_id string, page int, row int, col int, writable boolean, score double, ink_ratio double",
    "runs": "doc_id string, page int, row int, start_col int, end_col int, cell_count int, mean_score double, mean_ink_ratio double, range_id string",
    "regions": "doc_id string, page int, region_id string, region_no int, row_start int, row_end int, col_start int, col_end int, cell_count int, range_id string",
    "page_rasters": "doc_id string, page int, height int, width int, data binary",
    "free_zones": "doc_id string, page int, x_start_percent double, x_end_percent double, y_start_percent double, y_end_percent double, score double, row0 int, col0 int, zone_pos int",
    "ocr_pages": "doc_id string, page int, page_type string, text string",
    "blocks": "doc_id string, page int, block_id string, kind string, text string, row int, token string",
    "question_refs": "doc_id string, question_id int, ref_kind string, ref_pos int, block_ref string, is_attempted boolean, stem string",
    "items": "doc_id string, question_id int, item_index int, section_name string, start_page int, end_page int, start_y double, end_y double, student_answer string, is_attempted boolean, marking_page int, score_range string, score_box_range string",
    "evaluations": "doc_id string, question_id string, ord int, max_marks int, marks_awarded double, status string, feedback string, present array<string>",
    "annotations": f"doc_id string, item_index int, annotation_index int, page int, comment string, comment_font_pts string, comment_range string, comment_rows array<string>, anchor {ANCHOR}",
    "violations": "doc_id string, invariant string, page int, item_index int, annotation_index int, n bigint, check_no int, detail string",
    "placements": "session_id string, key string, ord bigint, action string, page int, x int, y int",
    "cover_marks": "doc_id string, line_no int, question_no int, marks_text string, x_percent double, y_percent double",
    "stage_log": "doc_id string, status string, elapsed_ms bigint",
    "layout_lines": "doc_id string, page int, line int, y int",
    "layout_gaps": "doc_id string, page int, after_line int, y_top int, y_bot int, height int, y_center int",
    "layout_strips": "doc_id string, page int, zone int, y_top int, y_bot int, height int",
    "word_gaps": "doc_id string, page int, line int, left_end int, right_start int, width int, x_center int",
    "free_rects": "doc_id string, page int, x1 int, y1 int, x2 int, y2 int, area int, cx double, cy double",
}
