"""Declared schemas of the engine's tables, as DDL."""

from __future__ import annotations

_MAP = "map<string,string>"

PROBLEMS_OPEN = f"problem_id string, description_string string, extract_args_fun string, tc_gen_fun string, input_testcases {_MAP}, output_testcases {_MAP}, num_input_files int"
PROBLEMS_DIRECTED = f"description_html string, description_string string, input_testcases {_MAP}, output_testcases {_MAP}, orig_lang_html string, orig_lang_string string, codenet_problem_id string"
SUBMISSIONS = "submission_id string, problem_id string, language string, status string, code string"
GENERATIONS = f"problem_id string, description_string string, input_testcases {_MAP}, output_testcases {_MAP}, model string, index int, formatted_prompt string, raw_generations array<string>, description string, programs array<string>, formatted_programs array<string>, original_description_string string"
OUTPUT_RECORD = f"code string, testcase_outputs {_MAP}, testcase_inputs {_MAP}, orig_testcase_outputs {_MAP}, problem_id string, generation_id int, error_string string, formatted_code string, raw_generation string, extracted_code string"
EXECUTIONS = "problem_id string, generation_id int, testcase_id string, pos int, input string, output string, expected string"
STATS = "k string, v double"
TEMPLATES = "template_name string, content string"

#: Outputs that stand for a failed run. Fixed values.
SENTINELS = ("Syntax Error", "Runtime Error", "Timeout", "Error", "Unknown Error")
#: Record types in report order. Fixed values.
RECORD_TYPES = ("all", "coh", "syn", "err", "acc", "inacc")
